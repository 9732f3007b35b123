"""Registered queries: one per operator of the inventory.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
are named exactly as in the DuckDB oracle (``plans/oracle.py``). Output
types are kept comparable across engines: dates as ISO strings, money as
doubles, scores rounded to 6 decimals, arrays joined to strings.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import fixtures as fx
from ..operators.matching import match

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


def iso(c) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def match_output(m: DataFrame) -> DataFrame:
    return m.select("filename", "invoice_number", iso("invoice_date").alias("invoice_date"),
                    dbl("total_amount").alias("total_amount"), "matched",
                    r6("match_score").alias("match_score"), iso("bank_date").alias("bank_date"),
                    dbl("bank_amount").alias("bank_amount"), "bank_description")


@query("match_best")
def q_match_best(spark, sf_dir):
    """J3 flagship: inv_v x txn_v, tolerance 0.02, 90 days, best per invoice."""
    m = match(fx.inv_v(spark, sf_dir), fx.txn_v(spark, sf_dir), 0.02, 90)
    return match_output(m)


# ---------------------------------------------------------------- joins / arg-max
from ..operators.matching import candidates, rank_candidates  # noqa: E402
from ..operators import flags as FL  # noqa: E402


@query("join_amount_band")
def q_join_amount_band(spark, sf_dir):
    """Amount band only (invoice dates ignored), tolerance 0.02."""
    inv = fx.inv_v(spark, sf_dir).withColumn("invoice_date", F.lit(None).cast("date"))
    c = candidates(inv, fx.txn_v(spark, sf_dir), 0.02, 90)
    return c.select("filename", "bank_row_idx",
                    (F.abs("bank_cents") - F.abs("_inv_cents")).alias("amount_diff_cents"))


@query("join_date_window")
def q_join_date_window(spark, sf_dir):
    """Amount band 5.00 and 0..90 days, orders x lineitem, with scores."""
    c = candidates(fx.inv_o(spark, sf_dir), fx.txn_l(spark, sf_dir), 5.00, 90)
    return c.select("filename", "bank_row_idx", iso("bank_date").alias("bank_date"),
                    (F.col("bank_cents") / 100).cast("double").alias("bank_amount"),
                    r6("match_score").alias("match_score"))


@query("argmax_best")
def q_argmax_best(spark, sf_dir):
    """A1: best of competing candidates, orders x lineitem, tolerance 5.00."""
    return match_output(match(fx.inv_o(spark, sf_dir), fx.txn_l(spark, sf_dir), 5.00, 90))


@query("match_ambiguity")
def q_match_ambiguity(spark, sf_dir):
    """Number of candidates per invoice."""
    m = match(fx.inv_o(spark, sf_dir), fx.txn_l(spark, sf_dir), 5.00, 90)
    return m.select("filename", "n_candidates")


@query("rank_candidates")
def q_rank_candidates(spark, sf_dir):
    """Candidates ranked per invoice (ranking form of A1)."""
    c = candidates(fx.inv_o(spark, sf_dir), fx.txn_l(spark, sf_dir), 5.00, 90, placed=True)
    return rank_candidates(c).select("filename", "bank_row_idx", r6("match_score").alias("match_score"),
                                     iso("bank_date").alias("bank_date"), F.col("bank_cents").cast("long").alias("bank_cents"),
                                     "bank_description", "bank_statement_id",
                                     F.col("rank").cast("long").alias("rank"))


def _inv_txn_pairs(spark, sf_dir):
    i = fx.inv_v(spark, sf_dir)
    t = fx.txn_v(spark, sf_dir)
    return t.join(i, t.row_idx == i.k, "inner")


@query("pred_amount_tolerance")
def q_pred_amount(spark, sf_dir):
    """P8 on each transaction and its own invoice (NULL total -> false)."""
    from ..operators.matching import amount_within
    from ..functions.amounts import amount_to_cents
    p = _inv_txn_pairs(spark, sf_dir)
    return p.select("row_idx", amount_within(amount_to_cents(F.col("amount")),
                                             amount_to_cents(F.col("total_amount")), 2).alias("amount_ok"))


@query("pred_date_window")
def q_pred_date(spark, sf_dir):
    """P9 on each transaction and its own invoice (NULL date -> true)."""
    from ..operators.matching import date_within
    p = _inv_txn_pairs(spark, sf_dir)
    return p.select("row_idx", date_within(F.col("invoice_date"), F.col("date"), 90).alias("date_ok"))


def _flagship_inputs(spark, sf_dir):
    """Invoices, transactions and their matches. A query that reads the
    matches once plans them once; nothing is kept."""
    inv = fx.inv_v(spark, sf_dir)
    txn = fx.txn_v(spark, sf_dir)
    return inv, txn, match(inv, txn, 0.02, 90)


@query("mark_invoices")
def q_mark_invoices(spark, sf_dir):
    inv, _, m = _flagship_inputs(spark, sf_dir)
    return FL.mark_invoices(inv, m).select("filename", "matched")


@query("mark_transactions")
def q_mark_transactions(spark, sf_dir):
    _, txn, m = _flagship_inputs(spark, sf_dir)
    return FL.mark_transactions(txn, m).select("statement_id", "row_idx", "matched")


def _stored(spark, *stored):
    """Tables of ``operators.stored``, each with a name and a folder of its own
    below the shared folder."""
    from uuid import uuid4
    from ..session import checkpoint_dir
    run = uuid4().hex
    return [store(df, f"stored_{run}_{i}", path=f"{checkpoint_dir(spark)}/stored-{run}-{i}") for i, (store, df) in enumerate(stored)]


@query("mark_stored_invoices")
def q_mark_stored_invoices(spark, sf_dir):
    """J4 on stored tables: bucket against bucket."""
    from ..operators import stored as ST
    inv, _, m = _flagship_inputs(spark, sf_dir)
    kept, used = _stored(spark, (ST.store_invoices, inv), (ST.store_matched_invoices, m))
    return ST.flag_stored(kept, used).select("filename", "matched")


@query("mark_stored_transactions")
def q_mark_stored_transactions(spark, sf_dir):
    """J5 on stored tables: bucket against bucket."""
    from ..operators import stored as ST
    _, txn, m = _flagship_inputs(spark, sf_dir)
    kept, used = _stored(spark, (ST.store_transactions, txn), (ST.store_used_transactions, m))
    return ST.flag_stored(kept, used).select("statement_id", "row_idx", "matched")


@query("anti_transactions")
def q_anti_transactions(spark, sf_dir):
    _, txn, m = _flagship_inputs(spark, sf_dir)
    return FL.unused_transactions(txn, m).select("statement_id", "row_idx")


@query("unmatched_invoices")
def q_unmatched(spark, sf_dir):
    inv, _, m = _flagship_inputs(spark, sf_dir)
    return FL.unmatched_invoices(FL.mark_invoices(inv, m)).select("filename")


@query("summary_counts")
def q_summary_counts(spark, sf_dir):
    """A3. Both flag joins read the matches: these are kept in the shared
    folder, not made twice."""
    from ..session import checkpoint_dir
    inv, txn, m = _flagship_inputs(spark, sf_dir)
    checkpoint_dir(spark)
    m = m.select("filename", "invoice_number", "total_amount", "matched", "bank_date", "bank_amount", "bank_description").checkpoint()
    return FL.summary_counts(FL.mark_invoices(inv, m), FL.mark_transactions(txn, m))


@query("sort_transactions")
def q_sort_transactions(spark, sf_dir):
    from ..operators.statements import sort_transactions
    t = sort_transactions(fx.txn_v(spark, sf_dir))
    return t.select("statement_id", "row_idx", iso("date").alias("date"))


# ---------------------------------------------------------------- extraction
from ..operators.extraction import extract_invoices, split_sections, split_sections_by_line  # noqa: E402
from ..functions import invoice_fields as IF  # noqa: E402
from ..functions.amounts import format_fr_amount, format_en_amount, parse_amount  # noqa: E402
from ..functions.dates import parse_date  # noqa: E402
from ..functions.text import strip_accents, standardize_header, text_lines  # noqa: E402
from ..functions.similarity import levenshtein_score, partial_ratio  # noqa: E402

# French month names used to render dates.
FR_MONTHS = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août",
             "septembre", "octobre", "novembre", "décembre"]


def _orders(spark, sf_dir):
    o = fx.base(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("custkey"),
                    F.to_date("o_orderdate").alias("d"),
                    (cents.cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias("total"),
                    cents.alias("cents"))


def _variant(k_mod, texts):
    out = None
    for i, t in enumerate(texts):
        out = F.when(k_mod == i, t) if out is None else out.when(k_mod == i, t)
    return out


@query("split_sections")
def q_split_sections(spark, sf_dir):
    """F10 + W1: two invoices per document, labelled name#1 / name#2."""
    s = split_sections(fx.invtext_v(spark, sf_dir))
    return s.select("filename", "section_no", "n_sections", "text")


@query("split_sections_by_line")
def q_split_sections_by_line(spark, sf_dir):
    """F10 + W1 + S1: documents of up to 2,500 lines that come as one row a line;
    each tenth section starts with a blank line, and the numbers of lines have gaps."""
    o = _orders(spark, sf_dir)
    text = F.concat(F.when(F.col("k") % 10 == 0, F.lit("\n")).otherwise(F.lit("")),
                    fx.section_text(F.col("k"), F.col("custkey"), F.col("d"), F.col("total")))
    lines = o.select(F.concat(F.lit("doc_"), F.floor(F.col("k") / 500).cast("bigint"), F.lit(".pdf")).alias("filename"), "k",
                     F.posexplode(F.split(text, "\n")).alias("i", "text")) \
        .select("filename", (F.col("k") * 8 + F.col("i")).alias("line_no"), "text")
    s = split_sections_by_line(lines, ["filename"], ["line_no"])
    return s.select("filename", "section_no", "n_sections", "text")


@query("extract_invoice_fields")
def q_extract_fields(spark, sf_dir):
    """Document text -> invoice rows (round trip of the section template)."""
    e = extract_invoices(fx.invtext_v(spark, sf_dir))
    return e.select("filename", "section_no", "invoice_number", iso("invoice_date").alias("invoice_date"),
                    dbl("total_amount").alias("total_amount"), "currency", "supplier_name",
                    "customer_name", "header_snippet")


@query("find_invoice_number")
def q_find_number(spark, sf_dir):
    """the three number patterns and a text without number."""
    o = _orders(spark, sf_dir)
    k = F.col("k")
    num = F.concat(F.lit("INV-"), k)
    text = _variant(k % 5, [
        F.concat(F.lit("Facture N° "), num, F.lit("\nMontant dû")),
        F.concat(F.lit("INVOICE # "), num, F.lit("\nDue")),
        F.concat(F.lit("Reçu\nfacture : "), num),
        F.concat(F.lit("Réf. client 12\nFacture numéro "), num),
        F.concat(F.lit("Bon de livraison "), k)])
    return o.select("k", IF.find_invoice_number(IF.folded(text)).alias("invoice_number"))


@query("find_invoice_date")
def q_find_date(spark, sf_dir):
    """labelled numeric, labelled ISO, labelled month name, unlabelled."""
    o = _orders(spark, sf_dir)
    k, d = F.col("k"), F.col("d")
    fr = F.concat(F.dayofmonth(d).cast("string"), F.lit(" "),
                  F.element_at(F.array(*map(F.lit, FR_MONTHS)), F.month(d)), F.lit(" "), F.year(d).cast("string"))
    text = _variant(k % 5, [
        F.concat(F.lit("Facture 1\nDate de facture : "), F.date_format(d, "dd/MM/yyyy")),
        F.concat(F.lit("Invoice 1\nInvoice date: "), F.date_format(d, "yyyy-MM-dd")),
        F.concat(F.lit("Facture 1\nDate : "), fr),
        F.concat(F.lit("Facture 1\nÉmise le "), F.date_format(d, "dd-MM-yyyy")),
        F.lit("Facture 1\nSans date")])
    return o.select("k", iso(IF.find_invoice_date(IF.lowered(text))).alias("invoice_date"))


@query("find_total_amount")
def q_find_total(spark, sf_dir):
    """F8: both labels, French and English numbers, the largest-amount
    fallback, a sub-total line that is hit first (as in the reference), and
    whole totals (keys below zero) grouped by dots."""
    o = _orders(spark, sf_dir)
    k, t = F.col("k"), F.col("total")
    sub = (t - F.lit(10)).cast("decimal(18,2)")
    text = _variant(k % 5, [
        F.concat(F.lit("Facture 1\nTotal TTC : "), format_fr_amount(t), F.lit(" EUR")),
        F.concat(F.lit("Facture 1\nMontant TTC : "), format_en_amount(t)),
        F.concat(F.lit("Facture 1\nTOTAL: "), t.cast("string")),
        F.concat(F.lit("Facture 1\nArticle A : 12,00\nArticle B : "), format_fr_amount(t)),
        F.concat(F.lit("Facture 1\nSous-total : "), format_fr_amount(sub), F.lit("\nTotal TTC : "),
                 format_fr_amount(t))])
    dotted = o.select((-k).alias("k"), F.concat(F.lit("Facture 1\nTotal TTC : "), _dotted(F.floor(t))).alias("text"))
    return o.select("k", text.alias("text")).unionByName(dotted) \
        .select("k", dbl(IF.find_total_amount(IF.lowered("text"))).alias("total_amount"))


@query("find_currency")
def q_find_currency(spark, sf_dir):
    """euro markers; EUR is also the default."""
    o = _orders(spark, sf_dir)
    k, t = F.col("k"), format_fr_amount(F.col("total"))
    text = _variant(k % 4, [F.concat(F.lit("Total : "), t, F.lit(" EUR")),
                            F.concat(F.lit("Total : "), t, F.lit(" €")),
                            F.concat(F.lit("Total : "), t, F.lit(" euros")),
                            F.concat(F.lit("Total : "), t, F.lit(" USD"))])
    low = IF.lowered(text)
    return o.select("k", IF.find_currency(low).alias("currency"), IF.currency_detected(low).alias("currency_detected"))


def _entity_text(spark, sf_dir):
    o = _orders(spark, sf_dir)
    k = F.col("k")
    sup = F.concat(F.lit("SOCIETE SUP "), k % 100)
    cus = F.concat(F.lit("CLIENT CUS "), F.col("custkey"))
    tail = F.concat(F.lit("Date de facture : "), F.date_format("d", "dd/MM/yyyy"), F.lit("\nTotal TTC : "),
                    format_fr_amount(F.col("total")), F.lit(" EUR"))
    head = F.concat(F.lit("Facture N° INV-"), k)
    text = _variant(k % 3, [
        F.concat_ws("\n", head, sup, cus, tail),
        F.concat_ws("\n", head, F.lower(sup), cus, tail),
        F.concat_ws("\n", head, sup, F.concat(F.lit("CLIENT "), sup, F.lit(" FILIALE")), tail)])
    return o.select("k", text_lines(text).alias("lines"))


@query("infer_supplier")
def q_infer_supplier(spark, sf_dir):
    """first entity-looking line."""
    e = _entity_text(spark, sf_dir)
    return e.select("k", IF.infer_supplier("lines").alias("supplier_name"))


@query("infer_customer")
def q_infer_customer(spark, sf_dir):
    """later entity line without supplier or invoice words."""
    e = _entity_text(spark, sf_dir)
    return e.select("k", IF.infer_customer("lines", IF.infer_supplier("lines")).alias("customer_name"))


@query("header_snippet")
def q_header_snippet(spark, sf_dir):
    """F13 on whole documents (noise corpus)."""
    d = fx.base(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", IF.header_snippet(text_lines("text")).alias("header_snippet"))


@query("text_max_amount")
def q_text_max_amount(spark, sf_dir):
    """A2: largest amount in a text built from an order's line items."""
    li = fx.base(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    amt = (F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("decimal(20,0)") / 100).cast("decimal(18,2)")
    line = F.concat(F.lit("Ligne "), F.col("l_linenumber"), F.lit(" : "), format_fr_amount(amt), F.lit(" EUR"))
    docs = li.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber"), line.alias("l")))),
                                 lambda x: x["l"]), "\n").alias("text"))
    return docs.select("k", dbl(IF.text_max_amount(IF.lowered("text"))).alias("max_amount"))


@query("fn_parse_amount")
def q_parse_amount(spark, sf_dir):
    """round trip of signed totals through twelve renderings: grouped,
    with no-break blanks, plain, scientific, and inside text; and of whole
    totals (keys below zero) grouped by dots, where one group is no decimals."""
    o = _orders(spark, sf_dir)
    k = F.col("k")
    v = F.when(k % 3 == 0, -F.col("total")).otherwise(F.col("total")).cast("decimal(18,2)")
    a = F.abs(v)
    sign = F.when(v < 0, F.lit("- ")).otherwise(F.lit("+ "))
    en = F.format_number(v, 2)
    text = _variant(k % 12, [
        format_fr_amount(v),
        F.translate(en, ",.", " ,"),
        F.translate(en, ",.", " ,"),
        en,
        F.translate(en, ",.", ".,"),
        F.translate(v.cast("string"), ".", ","),
        v.cast("string"),
        F.concat(F.lit("Montant: "), sign, format_fr_amount(a), F.lit(" EUR")),
        F.concat((v * 10).cast("decimal(18,1)").cast("string"), F.lit("E-1")),
        F.concat(v.cast("string"), F.lit("4")),
        F.concat(F.lit("  "), v.cast("string"), F.lit("0000 ")),
        F.concat(F.lit("Solde "), F.translate(en, ",.", "\u202f,"))])
    dotted = o.select((-k).alias("k"), _dotted(F.floor("total")).alias("text"))
    return o.select("k", text.alias("text")).unionByName(dotted).select("k", dbl(parse_amount("text")).alias("amount"))


def _dotted(whole):
    """A whole amount as people group it: ``1.234``, ``12.345.678``."""
    return F.translate(F.format_number(whole, 0), ",", ".")


@query("fn_parse_date")
def q_parse_date(spark, sf_dir):
    """round trip of order dates through eleven renderings, plus an
    impossible day."""
    o = _orders(spark, sf_dir)
    k, d = F.col("k"), F.col("d")
    fr = F.concat(F.dayofmonth(d).cast("string"), F.lit(" "),
                  F.element_at(F.array(*map(F.lit, FR_MONTHS)), F.month(d)), F.lit(" "), F.year(d).cast("string"))
    text = _variant(F.when(k % 5 == 4, 8 + k % 3).otherwise(k % 8), [
        F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "d/M/yy"), F.date_format(d, "yyyy-MM-dd"), fr,
        F.date_format(d, "d MMM yyyy"), F.date_format(d, "dd.MM.yyyy"), F.date_format(d, "yyyy-MM-dd 00:00:00"),
        F.when(k % 16 == 7, F.concat(F.lit("31/02/"), F.year(d))).otherwise(F.date_format(d, "MMMM d, yyyy")),
        F.date_format(d, "dd-MMM-yyyy"), F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00:00")),
        F.date_format(d, "yyyyMMdd")])
    return o.select("k", iso(parse_date(text)).alias("date"))


@query("fn_strip_accents")
def q_strip_accents(spark, sf_dir):
    """F3 on whole documents."""
    d = fx.base(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", strip_accents("text").alias("text"))


@query("fn_std_header")
def q_std_header(spark, sf_dir):
    """F4 on whole documents."""
    d = fx.base(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", standardize_header("text").alias("std"))


@query("score_levenshtein")
def q_score_levenshtein(spark, sf_dir):
    """normalised Levenshtein similarity x 100."""
    t = fx.txn_v(spark, sf_dir)
    num = F.concat(F.lit("INV-"), (F.col("row_idx") * 7) % 10000)
    return t.select("row_idx", r6(levenshtein_score(num, F.col("description"))).alias("score"))


@query("score_partial_ratio_hit")
def q_partial_ratio_hit(spark, sf_dir):
    """F16: partial ratio reaches 100 exactly when one string contains the other."""
    t = fx.txn_v(spark, sf_dir)
    num = F.concat(F.lit("INV-"), (F.col("row_idx") * 7) % 10000)
    return t.select("row_idx", (partial_ratio(num, F.col("description")) >= 100.0).alias("hit"))


# ---------------------------------------------------------------- statements / sources
from ..operators.columns import detect_columns, header_best_match, resolve_suggested_column  # noqa: E402
from ..operators import statements as ST  # noqa: E402
from ..sources.delimited import delimited_to_rows  # noqa: E402
from ..sources.lines import parse_statement_lines  # noqa: E402
from ..sources.routing import route_by_extension, union_sources  # noqa: E402
from ..sources.documents import concat_pages  # noqa: E402


def _layouts(spark, sf_dir):
    """The header list of every transaction row, changed by its key: case,
    accents, typos, blanks, a number, and a missing first or last column."""
    c = fx.cells_v(spark, sf_dir).select("row_idx", "headers")
    k, n = F.col("row_idx"), F.size("headers")

    def change(x):
        v = k % 8
        return (F.when(v == 1, F.upper(x)).when(v == 2, F.lower(x)).when(v == 3, strip_accents(x))
                .when(v == 4, F.concat(x, F.lit(" EUR"))).when(v == 5, F.substr(x, F.lit(2)))
                .when(v == 6, F.concat(x, F.lit("s"))).when(v == 7, F.concat(F.lit("  "), F.replace(x, F.lit(" "), F.lit("_"))))
                .otherwise(x))
    cut = F.floor(k / 8) % 3
    part = F.when(cut == 1, F.slice("headers", F.lit(1), n - 1)).when(cut == 2, F.slice("headers", F.lit(2), n - 1)) \
        .otherwise(F.col("headers"))
    changed = F.transform(part, lambda x, i: F.when((i == 0) & (k % 7 == 0), F.concat(
        change(x), F.lit(" "), (k % 101).cast("string"))).otherwise(change(x)))
    return c.select(changed.alias("headers"))


def _tx_out(df):
    return df.select("statement_id", "row_idx", iso("date").alias("date"), "description",
                     dbl("amount").alias("amount"))


@query("header_best_match")
def q_header_best_match(spark, sf_dir):
    """A5 + F18: per layout and field, exact / containing / most similar header."""
    b = header_best_match(_layouts(spark, sf_dir))
    return b.select(F.array_join("headers", "|").alias("layout"), "field", "exact_idx", "contains_idx",
                    "jw_idx", r6("jw_best").alias("jw_best"))


@query("detect_columns")
def q_detect_columns(spark, sf_dir):
    """column map per distinct header list, with reject reason."""
    d = detect_columns(_layouts(spark, sf_dir))
    return d.select(F.array_join("headers", "|").alias("layout"), "date_idx", "description_idx", "amount_idx",
                    "debit_idx", "credit_idx", "reject_reason")


# The money headers of the derived layouts.
IF_HEADERS = {"Montant": "amount", "Amount": "amount", "Débit": "debit", "Debit": "debit", "Crédit": "credit",
              "Credit": "credit"}

# Suggested column names, as a model might answer them.
SUGGESTIONS = ["Date", "libelle", "Montant EUR", "debit", "xyz", ""]


@query("resolve_suggested_column")
def q_resolve_suggested(spark, sf_dir):
    """suggested name -> real header (equal standardised, else JW >= 0.75)."""
    c = fx.cells_v(spark, sf_dir)
    sug = F.element_at(F.array(*map(F.lit, SUGGESTIONS)), (F.col("row_idx") % 6 + 1).cast("int"))
    r = resolve_suggested_column(c.select("statement_id", "row_idx", "headers", sug.alias("suggested")))
    return r.select("statement_id", "row_idx", "resolved")


@query("harmonise_statements")
def q_harmonise(spark, sf_dir):
    """Four layouts -> one transaction table."""
    return _tx_out(ST.load_statements(fx.cells_v(spark, sf_dir)))


@query("signed_amount")
def q_signed_amount(spark, sf_dir):
    """Amount cell, else debit / credit cells -> signed amount."""
    c = fx.cells_v(spark, sf_dir)
    at = {sid: {h: i for i, h in enumerate(strip) } for sid, strip in (
        (sid, [IF_HEADERS.get(h, h) for h in heads]) for sid, heads in fx.LAYOUTS.items())}

    def cell(name):
        out = F.lit(None).cast("string")
        for sid, places in at.items():
            if name in places:
                out = F.when(F.col("statement_id") == sid, F.get("cells", places[name])).otherwise(out)
        return parse_amount(out)
    return c.select("statement_id", "row_idx",
                    dbl(ST.signed_amount(cell("amount"), cell("debit"), cell("credit"))).alias("amount"))


def _damaged_cells(spark, sf_dir):
    c = fx.cells_v(spark, sf_dir)
    k = F.col("row_idx")

    def dmg(x, i):
        amount_cell = (i >= 2) & ~((F.col("statement_id") == "st_2") & (i == 5))
        return (F.when((i == 0) & (k % 19 == 0), F.lit("xx/yy/zzzz"))
                .when((i == 1) & (k % 23 == 0), F.lit(""))
                .when(amount_cell & (k % 29 == 0), F.lit(""))
                .otherwise(x))
    return c.withColumn("cells", F.transform("cells", dmg))


@query("filter_valid_tx")
def q_filter_valid(spark, sf_dir):
    """Rows without date, description or amount are dropped."""
    return _tx_out(ST.filter_valid(ST.harmonise(_damaged_cells(spark, sf_dir))))


@query("agg_reject_report")
def q_reject_report(spark, sf_dir):
    """Rows in / kept / dropped by reason per statement."""
    return ST.reject_report(ST.harmonise(_damaged_cells(spark, sf_dir)))


def _cells_str(df):
    return df.select("statement_id", "row_idx", F.array_join("headers", "|").alias("headers"),
                     F.array_join("cells", "|").alias("cells"))


@query("src_grid_header")
def q_grid_header(spark, sf_dir):
    """S3: header row found in a headerless grid."""
    return _cells_str(ST.grid_to_rows(fx.grid_v(spark, sf_dir)))


_SEP_BY_STATEMENT = {"st_0": ";", "st_1": "\t", "st_2": "|", "st_3": ","}


def delimited_lines(spark, sf_dir):
    """The cells view written as delimited text, one separator per statement;
    the comma file quotes every cell. Line 0 is blank, line 1 the header."""
    c = fx.cells_v(spark, sf_dir)
    sid = F.col("statement_id")

    def render(arr):
        q = F.transform(arr, lambda x: F.concat(F.lit('"'), x, F.lit('"')))
        return (F.when(sid == "st_0", F.array_join(arr, ";")).when(sid == "st_1", F.array_join(arr, "\t"))
                .when(sid == "st_2", F.array_join(arr, "|")).otherwise(F.array_join(q, ",")))
    broken = (sid == "st_3") & (F.col("row_idx") % 6 == 0)  # records with a line break inside quotes
    stray = (sid != "st_3") & (F.col("row_idx") % 3 == 1)  # a quote inside a field
    whole = c.select("statement_id", (F.col("row_idx") * 2 + 2).alias("line_no"),
                     F.when(broken, F.transform("cells", lambda x: F.replace(x, F.lit("VIR "), F.lit("VIR\n"))))
                     .when(stray, F.transform("cells", lambda x: F.replace(x, F.lit("VIR "), F.lit('VIR 5" '))))
                     .otherwise(F.col("cells")).alias("cells"))
    data = whole.select("statement_id", "line_no", F.posexplode(F.split(render(F.col("cells")), "\n")).alias("_p", "line")) \
        .select("statement_id", (F.col("line_no") + F.col("_p")).alias("line_no"), "line")
    top = fx.heads_v(spark, sf_dir).select("statement_id", F.posexplode(F.array(F.lit(""), render(F.col("headers"))))
                                           .alias("line_no", "line"))
    return top.withColumn("line_no", F.col("line_no").cast("long")).unionByName(data)


@query("src_csv_sniff")
def q_csv_sniff(spark, sf_dir):
    """Separator sniffing and quote-aware splitting; a third of the rows hold
    a quote inside a field, which opens nothing."""
    return _cells_str(delimited_to_rows(delimited_lines(spark, sf_dir)))


@query("src_csv_yield")
def q_csv_yield(spark, sf_dir):
    """Headers that several separators split; the one under which the lines
    below are transactions is taken."""
    lines = delimited_lines(spark, sf_dir).where(F.col("statement_id").isin("st_0", "st_1"))
    more = F.when(F.col("statement_id") == "st_0", F.replace("line", F.lit("Libell\u00e9"), F.lit("Libell\u00e9, d\u00e9tail, suite"))) \
        .otherwise(F.replace("line", F.lit("Label"), F.lit("Label; a|b|c, d")))
    return _cells_str(delimited_to_rows(lines.withColumn("line", F.when(F.col("line_no") == 1, more).otherwise(F.col("line")))))


@query("src_statement_lines")
def q_statement_lines(spark, sf_dir):
    """Date + description + amount lines; balance lines skipped; and whole
    amounts (statements ``w_``) grouped by dots."""
    t = fx._txn_base(spark, sf_dir)
    whole = t.select(F.concat(F.lit("w_"), "statement_id").alias("statement_id"), F.col("row_idx").alias("line_no"), F.concat_ws(
        " ", F.date_format("date", "dd/MM/yyyy"), F.col("description"), _dotted(F.expr("cents div 100"))).alias("line"))
    return _tx_out(parse_statement_lines(fx.lines_v(spark, sf_dir).unionByName(whole)))


# File extensions cycled over by the routing check.
EXTENSIONS = [".PDF", ".csv", ".XLSX", ".xls", ".txt"]


@query("src_route_format")
def q_route_format(spark, sf_dir):
    """Routing by file extension; unknown extensions are rejected rows."""
    o = fx.table(spark, sf_dir, "orders")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    files = o.select(F.concat(F.lit("f"), F.col("o_orderkey"), ext).alias("filename"))
    return route_by_extension(files).select("filename", "format", "reject_reason")


@query("set_union_sources")
def q_union_sources(spark, sf_dir):
    """Grid rows plus the statement lines that no grid row repeats."""
    grid = ST.load_statements(fx.cells_v(spark, sf_dir).where(F.col("statement_id").isin("st_0", "st_1")))
    grid = grid.withColumn("description", F.when(F.col("row_idx") % 2 == 1, F.concat("description", F.lit(" G")))
                           .otherwise(F.col("description")))
    lines = parse_statement_lines(fx.lines_v(spark, sf_dir))
    u = union_sources(grid, lines)
    return u.select("statement_id", "row_idx", iso("date").alias("date"), "description",
                    dbl("amount").alias("amount"), "row_source")


@query("src_page_concat")
def q_page_concat(spark, sf_dir):
    """Pages (conversation turns) joined into one document text."""
    return concat_pages(fx.table(spark, sf_dir, "conversations"), "conv_id", "turn")


# ---------------------------------------------------------------- model answers
from ..operators.enrichment import json_invoice_fields, json_transactions, overlay  # noqa: E402
from ..functions.text import json_block  # noqa: E402


@query("json_block")
def q_json_block(spark, sf_dir):
    """JSON object cut out of a free-text answer."""
    return fx.resp_v(spark, sf_dir).select("k", json_block("answer").alias("block"))


@query("json_invoice_fields")
def q_json_invoice_fields(spark, sf_dir):
    """answer -> invoice fields (JSON null and blanks stay NULL). Answers of
    keys below zero give a total of three decimals, as a JSON number (even) or
    as a text, where it is grouped, and quote a key inside a text."""
    o = _orders(spark, sf_dir)
    thousandths = F.concat((F.col("cents") % 999_000 / 1000).cast("decimal(18,3)").cast("string"))
    total = F.when(F.col("k") % 2 == 0, thousandths).otherwise(F.concat(F.lit('"'), _dotted(F.floor("total")), F.lit('"')))
    typed = o.select((-F.col("k")).alias("k"), F.concat(
        F.lit('{"note":"the \\"total_amount\\": 1, \\"currency\\":\\"usd\\"","lines":[{"total_amount":'), total, F.lit("}]}")).alias("answer"))
    p = json_invoice_fields(fx.resp_v(spark, sf_dir).select("k", "answer").unionByName(typed))
    return p.select("k", "llm_invoice_number", iso("llm_invoice_date").alias("llm_invoice_date"),
                    dbl("llm_total_amount").alias("llm_total_amount"), "llm_currency")


def tx_answers(spark, sf_dir):
    """Answers listing up to ten transactions each; the amount comes as a
    JSON number, as ``amount_text`` or as ``montant``; some items have a
    blank description."""
    t = fx._txn_base(spark, sf_dir)
    k = F.col("row_idx")
    amt = (F.col("cents").cast("decimal(20,0)") / 100).cast("decimal(18,2)")
    q = F.lit('"')
    head = F.concat(F.lit('{"date":"'), F.date_format("date", "yyyy-MM-dd"), F.lit('","description":"'),
                    F.when(k % 4 == 3, F.lit("")).otherwise(F.col("description")), q)
    item = F.concat(head, F.when(k % 4 == 0, F.concat(F.lit(',"amount":'), amt.cast("string")))
                    .when(k % 4 == 1, F.concat(F.lit(',"amount_text":"'), format_fr_amount(amt), q))
                    .otherwise(F.concat(F.lit(',"montant":"'), format_en_amount(amt), q)), F.lit("}"))
    chunk = F.concat(F.col("statement_id"), F.lit("#"), F.floor(k / 10).cast("bigint"))
    return t.groupBy(chunk.alias("statement_id")).agg(
        F.concat(F.lit('Réponse : {"transactions":['),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("i")))),
                                          lambda x: x["i"]), ","), F.lit("]}")).alias("answer"))


@query("json_transactions")
def q_json_transactions(spark, sf_dir):
    """transactions listed in answers."""
    return _tx_out(json_transactions(tx_answers(spark, sf_dir)))


@query("overlay_enrichment")
def q_overlay(spark, sf_dir):
    """J7 + P6: non-empty answer fields replace heuristic ones."""
    inv = fx.inv_v(spark, sf_dir)
    p = json_invoice_fields(fx.resp_v(spark, sf_dir)).drop("k")
    again = p.withColumns({f"llm_{f}": F.lit(None).cast(p.schema[f"llm_{f}"].dataType) for f in ("invoice_date", "currency")})
    o = overlay(inv, p.unionByName(again), on=["filename"])  # a poorer second answer for every file
    return o.select("filename", "invoice_number", iso("invoice_date").alias("invoice_date"),
                    dbl("total_amount").alias("total_amount"), "currency")


# ---------------------------------------------------------------- sinks
from ..sinks.writers import csv_line, invoice_xml_element, invoice_xml_fields, json_line  # noqa: E402


@query("sink_xml_rows")
def q_sink_xml(spark, sf_dir):
    """One <invoice> element per invoice."""
    inv = fx.inv_v(spark, sf_dir)
    f = invoice_xml_fields(inv.withColumn("filename", F.concat(F.col("filename"), F.lit("&<x>"))))
    return f.select(invoice_xml_element(f).alias("xml"))


def _match_cells(spark, sf_dir):
    inv, _, m = _flagship_inputs(spark, sf_dir)
    return m.select("filename", "invoice_number", "invoice_date", "total_amount", "matched",
                    F.round("match_score", 6).cast("decimal(12,6)").alias("match_score"),
                    "bank_date", "bank_amount", "bank_description")


@query("sink_csv_rows")
def q_sink_csv(spark, sf_dir):
    """Match rows as CSV lines."""
    m = _match_cells(spark, sf_dir)
    return m.select(csv_line([F.col(c) for c in m.columns]).alias("line"))


@query("sink_json_rows")
def q_sink_json(spark, sf_dir):
    """Match rows as JSON objects (NULL fields omitted)."""
    m = _match_cells(spark, sf_dir)
    return m.select(json_line([F.col(c) for c in m.columns]).alias("json"))


@query("summary_invoices")
def q_summary_invoices(spark, sf_dir):
    """P4 in the full flow: extracted invoices flagged against the line
    statements, without raw text."""
    from .reconcile import reconcile
    r = reconcile(fx.invtext_v(spark, sf_dir), statement_lines=fx.lines_v(spark, sf_dir))
    s = r["invoices"]
    return s.select("filename", "invoice_number", iso("invoice_date").alias("invoice_date"),
                    dbl("total_amount").alias("total_amount"), "currency", "supplier_name", "customer_name",
                    "matched")


from ..operators.enrichment import json_column_map  # noqa: E402

# Column suggestions cycled over by the column-map answers
# (None is a JSON null, "" a blank answer).
COLUMN_SUGGESTIONS = [
    ("Date", "Libellé", "Montant", None, None),
    ("booking date", "label", "", "Débit", "Crédit"),
    ("Date opération", "Description", "Amount", "", None),
    ("", "Détails", None, "Debit", "Credit"),
]
COLUMN_KEYS = ["date_column", "description_column", "amount_column", "debit_column", "credit_column"]


def column_answers(spark, sf_dir):
    """One free-text answer per transaction row suggesting its columns."""
    t = fx.txn_v(spark, sf_dir).select("statement_id", "row_idx")
    v = F.col("row_idx") % len(COLUMN_SUGGESTIONS)

    def js(i, key):
        out = None
        for n, sug in enumerate(COLUMN_SUGGESTIONS):
            val = F.lit("null") if sug[i] is None else F.lit('"' + sug[i] + '"')
            out = F.when(v == n, val) if out is None else out.when(v == n, val)
        return F.concat(F.lit(('{' if i == 0 else ',') + f'"{key}":'), out)
    body = F.concat(*[js(i, k) for i, k in enumerate(COLUMN_KEYS)], F.lit("}"))
    return t.select("statement_id", "row_idx", F.concat(F.lit("Colonnes : "), body, F.lit(" ok")).alias("answer"))


@query("json_column_map")
def q_json_column_map(spark, sf_dir):
    """suggested columns from an answer (JSON null and blanks -> NULL)."""
    return json_column_map(column_answers(spark, sf_dir)).select("statement_id", "row_idx", *COLUMN_KEYS)


@query("match_keyed")
def q_match_keyed(spark, sf_dir):
    """J3 with an equality key: each invoice only meets the transactions of
    its customer's statement (statement_id joins the bucket keys)."""
    inv = fx.inv_v(spark, sf_dir).withColumn("statement_id", F.concat(F.lit("st_"), F.col("o_custkey") % 4))
    m = match(inv, fx.txn_v(spark, sf_dir), 0.02, 90, keys=["statement_id"], invoice_key=["filename"])
    return match_output(m)


@query("match_salted")
def q_match_salted(spark, sf_dir):
    """J3 through the hot-key path: bucket pairs holding two or more
    transactions are salted 8 ways (their invoices replicated); the result
    must equal the plain match."""
    m = match(fx.inv_v(spark, sf_dir), fx.txn_v(spark, sf_dir), 0.02, 90, hot_key_salts=8, hot_key_rows=2)
    return match_output(m)


def _odd_headers(spark, sf_dir):
    """The cells view under headers that no rule recognises for st_0 and
    st_2, and an answer per statement that names its columns (st_2's answer
    names no such column)."""
    c = fx.cells_v(spark, sf_dir)
    sid = F.col("statement_id")
    hidden = F.transform("headers", lambda x, i: F.concat(F.lit("zq"), i.cast("string")))
    rows = c.withColumn("headers", F.when(sid.isin("st_0", "st_2"), hidden).otherwise(F.col("headers")))
    told = c.select("statement_id").distinct().select("statement_id", F.when(sid == "st_0", F.lit(
        'Oui : {"date_column":"ZQ0","description_column":"zq1","amount_column":"zq 2"}')).otherwise(
        F.lit('{"date_column":"wwwww","description_column":"kkkkk","amount_column":null}')).alias("answer"))
    return rows, told


@query("harmonise_suggested")
def q_harmonise_suggested(spark, sf_dir):
    """F24 -> F20 -> J8: unrecognised headers are read through a suggestion."""
    rows, told = _odd_headers(spark, sf_dir)
    return _tx_out(ST.load_statements(rows, suggestions=json_column_map(told)))


@query("reconcile_rejects")
def q_reconcile_rejects(spark, sf_dir):
    """Rejects of a run: statements without any transaction and why, also those
    of a header alone and empty or unsupported files of the inventory; answers
    listing transactions take the place of missing lines."""
    from .reconcile import load_transactions
    rows, told = _odd_headers(spark, sf_dir)
    lines = fx.lines_v(spark, sf_dir)
    blank = lines.select(F.concat(F.lit("blank_"), "statement_id").alias("statement_id"), "line_no", F.lit(" ").alias("line"))
    grid = fx.grid_v(spark, sf_dir).select(F.concat(F.lit("bare_"), "statement_id").alias("statement_id"), "row_idx",
                                           F.slice("cells", 1, 1).alias("cells"))
    headed = fx.heads_v(spark, sf_dir).select(F.concat(F.lit("head_"), "statement_id").alias("statement_id"),
                                              F.lit(0).cast("long").alias("line_no"), F.array_join("headers", ";").alias("line"))
    ids = fx.heads_v(spark, sf_dir).select("statement_id")
    files = route_by_extension(reduce(DataFrame.union, [ids.select(F.concat(F.lit(p), "statement_id", F.lit(x)).alias("statement_id"), F.lit(n).alias("length"))
                                                        for p, x, n in (("empty_", ".csv", 0), ("doc_", ".odt", 9), ("head_", "", 9))]), "statement_id")
    files = files.withColumn("reject_reason", F.when(F.startswith("statement_id", F.lit("head_")), F.lit(None))
                             .otherwise(F.coalesce("reject_reason", F.when(F.col("length") == 0, "empty file"))))
    odd = headed.withColumn("statement_id", F.replace("statement_id", F.lit("head_"), F.lit("doc_"))) \
        .select(F.concat("statement_id", F.lit(".odt")).alias("statement_id"), "line_no", F.lit("a;b").alias("line"))
    tx, rejects = load_transactions(rows, delimited_lines=blank.unionByName(headed).unionByName(odd), files=files, statement_lines=lines.withColumn(
        "statement_id", F.concat(F.lit("l_"), "statement_id")), grids=grid, column_answers=told,
        transaction_answers=tx_answers(spark, sf_dir))
    counted = tx.groupBy("row_source").agg(F.count(F.lit(1)).alias("rows"))
    return rejects.select("statement_id", "reason", F.lit(0).cast("long").alias("rows")).unionByName(
        counted.select(F.concat(F.lit("from "), "row_source").alias("statement_id"), F.lit(None).cast("string").alias("reason"),
                       "rows"))


@query("match_repeated_names")
def q_match_repeated_names(spark, sf_dir):
    """J3 where three invoices share a file name, and one transaction lies
    thousands of years ahead."""
    inv = fx.inv_v(spark, sf_dir).withColumn("filename", F.concat(F.lit("inv_"), F.floor(F.col("k") / 3), F.lit(".pdf")))
    txn = fx.txn_v(spark, sf_dir)
    far = txn.agg(F.max("row_idx").alias("m")).select(
        F.lit("far").alias("statement_id"), (F.col("m") + 1).alias("row_idx"), F.lit("9999-12-31").cast("date").alias("date"),
        F.lit("FAR").alias("description"), F.lit("1.00").cast("decimal(18,2)").alias("amount"))
    return match_output(match(inv, txn.unionByName(far), 0.02, 90))
