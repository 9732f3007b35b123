"""Model answers as data.

The reference can ask a local model for invoice fields, bank columns or
transactions. Calling a model is not part of this library; its *answers*
arrive as a text column and are parsed here as VARIANT values, which keep
numbers and texts apart.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.amounts import number_amount, parse_amount
from ..functions.dates import parse_date
from ..functions.text import json_block, ktrim, let
from .once import evaluate_once

COLUMNS_SCHEMA = ("date_column string, description_column string, amount_column string, "
                  "debit_column string, credit_column string")


def _blank_to_null(c):
    return let(ktrim(c), lambda t: F.when(t != "", t))


# How deep answers are searched: what models wrap a result in is a level or two.
MAX_DEPTH = 6


def parse_answer(text):
    """The JSON object in a free-text answer as a VARIANT; NULL if there is
    none or it is not valid JSON."""
    return F.try_parse_json(json_block(text))


def _get(v, path: str, type_: str = "variant"):
    return F.try_variant_get(v, path, type_)


def find_value(answer, key: str):
    """The value of ``key`` in the object or, level by level, in the objects and
    lists within it (the first of a level), as a VARIANT. Strings are values
    here, so a key quoted within one is not found. NULL if missing or null."""
    def inner(v):
        values = F.map_values(F.coalesce(_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
        return F.concat(values, F.coalesce(_get(v, "$", "array<variant>"), F.array().cast("array<variant>")))
    def search(level, depth):
        hits = F.filter(F.transform(level, lambda v: _get(v, f"$.{key}")), lambda v: v.isNotNull() & ~F.is_variant_null(v))
        hit = F.get(hits, F.lit(0))
        if depth == 1:
            return hit
        below = F.flatten(F.transform(F.filter(level, lambda v: v.isNotNull()), inner))
        return F.coalesce(hit, F.when(F.size(level) > 0, let(below, lambda deeper: search(deeper, depth - 1))))
    return let(F.array(answer), lambda level: search(level, MAX_DEPTH))


def _kind(v):
    return F.schema_of_variant(v)


def text_value(v):
    """A scalar VARIANT as text; NULL for objects, lists and blanks."""
    def scalar(v):
        return let(_kind(v), lambda kind: ~F.startswith(kind, F.lit("OBJECT")) & ~F.startswith(kind, F.lit("ARRAY")))
    return let(v, lambda v: _blank_to_null(F.when(scalar(v), _get(v, "$", "string"))))


def amount_of(v):
    """Money by type: a JSON text is read as people write amounts (``"1.234"``
    is 1234), a JSON number is that number (``1.234`` is 1.23)."""
    def by_kind(v, kind):
        return F.when(kind == "STRING", parse_amount(text_value(v))) \
            .when(F.rlike(kind, F.lit("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)")), number_amount(_get(v, "$", "string")))
    return let(v, lambda v: let(_kind(v), lambda kind: by_kind(v, kind)))


def json_invoice_fields(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """invoice fields from a free-text answer holding a JSON object, at
    any of MAX_DEPTH levels. JSON null and blank values stay NULL (they never overlay)."""
    names = ["invoice_number", "invoice_date", "total_amount", "currency"]
    parsed = evaluate_once(answers, {"_v": parse_answer(answer_col)})
    top = {n: _get(F.col("_v"), f"$.{n}") for n in names}
    plain = {n: F.when(v.isNotNull() & ~F.is_variant_null(v), v) for n, v in top.items()}
    # most answers hold their fields at the top; only what is missing there is searched for
    found = evaluate_once(parsed, {f"_{n}": F.coalesce(plain[n], F.when(F.rlike(answer_col, F.lit(r"(?s)\{.*[\[{]")), find_value(F.col("_v"), n)))
                                   for n in names})
    return evaluate_once(found, {
        "llm_invoice_number": text_value(F.col("_invoice_number")),
        "llm_invoice_date": parse_date(text_value(F.col("_invoice_date"))),
        "llm_total_amount": amount_of(F.col("_total_amount")),
        "llm_currency": F.upper(text_value(F.col("_currency")))}).drop("_v", *[f"_{n}" for n in names])


def json_transactions(answers: DataFrame, answer_col: str = "answer",
                      id_col: str = "statement_id") -> DataFrame:
    """``{"transactions": [{date, description, amount}]}`` -> rows.
    The amount may also come as ``amount_text`` or ``montant``; items with a
    blank date or description are skipped, then rows need a date and an
    amount that parse."""
    told = evaluate_once(answers.select(id_col, answer_col), {"_v": _get(parse_answer(answer_col), "$.transactions")})
    items = told.lateralJoin(told.sparkSession.tvf.variant_explode(F.col("_v").outer())) \
        .select(F.col(id_col), F.col("pos").cast("long").alias("row_idx"), F.col("value").alias("t"))
    amounts = [F.when(~F.is_variant_null(v), v) for v in (_get(F.col("t"), f"$.{n}") for n in ("amount", "amount_text", "montant"))]
    fields = evaluate_once(items, {"_date": text_value(_get(F.col("t"), "$.date")), "description": text_value(_get(F.col("t"), "$.description")),
                                   "_amount": F.coalesce(*amounts)})
    kept = fields.where(F.col("_date").isNotNull() & F.col("description").isNotNull())
    rows = evaluate_once(kept, {"date": parse_date(F.col("_date")), "amount": amount_of(F.col("_amount"))})
    return rows.where(F.col("date").isNotNull() & F.col("amount").isNotNull()) \
        .select(id_col, "row_idx", "date", "description", "amount")


def json_column_map(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """suggested column names (five keys) from a free-text answer."""
    p = F.from_json(json_block(answer_col), COLUMNS_SCHEMA)
    return answers.select("*", *[_blank_to_null(p[k]).alias(k) for k in
                                 ["date_column", "description_column", "amount_column",
                                  "debit_column", "credit_column"]])


OVERLAY_FIELDS = ["invoice_number", "invoice_date", "total_amount", "currency"]


def overlay(invoices: DataFrame, parsed_answers: DataFrame,
            on: Sequence[str] | None = None) -> DataFrame:
    """J7 + P6: left join of parsed answers to invoices; a non-empty answer
    field replaces the heuristic one. ``on``: filename, and section_no where
    both sides have it.

    Several answers for one key count as one: the one with the most fields,
    the largest values among equals. So invoices never multiply."""
    if on is None:
        on = ["filename"] + (["section_no"] if "section_no" in invoices.columns
                             and "section_no" in parsed_answers.columns else [])
    on = list(on)
    fields = [f"llm_{f}" for f in OVERLAY_FIELDS]
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    ans = parsed_answers.groupBy(*on).agg(F.max(F.struct(filled.alias("_n"), *fields)).alias("_a")) \
        .select(*on, *[F.col("_a")[f].alias(f) for f in fields])
    j = invoices.join(ans, on=on, how="left")
    for f in OVERLAY_FIELDS:
        j = j.withColumn(f, F.coalesce(F.col(f"llm_{f}"), F.col(f)))
    return j.drop(*fields)
