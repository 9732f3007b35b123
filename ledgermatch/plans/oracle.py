"""DuckDB oracle SQL for the registered queries.

The derived views are restated as CTEs over the driver's parquet views.
DuckDB's regex engine has no look-around, so text operators are checked by
round trip: Spark renders text from known columns and parses it back; the
oracle states the known columns directly.
"""

from __future__ import annotations

CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"

INV_V = f"""inv_v AS (
  SELECT o_orderkey AS k, 'inv_' || o_orderkey || '.pdf' AS filename,
         CASE WHEN o_orderkey % 11 <> 0 THEN 'INV-' || o_orderkey END AS invoice_number,
         CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS invoice_date,
         CASE WHEN o_orderkey % 17 <> 0 THEN {CENTS} END AS cents,
         o_custkey
  FROM orders)"""

TXN_V = f"""txn_v AS (
  SELECT 'st_' || (o_custkey % 4) AS statement_id, o_orderkey AS row_idx,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 + CASE WHEN o_orderkey % 3 = 0 THEN 200 ELSE 0 END AS INTEGER) AS date,
         'VIR INV-' || o_orderkey || ' CLIENT' AS description,
         ({CENTS} + (o_orderkey % 7 - 3)) * CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END AS cents
  FROM orders)"""


def lev_score(num: str, desc: str) -> str:
    return (f"(CASE WHEN {num} IS NULL OR trim({num}) = '' THEN 0.0 ELSE 100.0 * (1.0 - "
            f"CAST(levenshtein(lower({num}), lower({desc})) AS DOUBLE) / "
            f"CAST(greatest(length({num}), length({desc})) AS DOUBLE)) END)")


def candidates_cte(inv: str = "inv_v", txn: str = "txn_v", tol: int = 2, days: int = 90) -> str:
    return f"""cand AS (
  SELECT i.k, t.statement_id, t.row_idx, t.date, t.description, t.cents AS tcents,
         {lev_score('i.invoice_number', 't.description')}
         + CASE WHEN abs(t.cents) = abs(i.cents) THEN 5.0 ELSE 0.0 END AS score
  FROM {inv} i JOIN {txn} t
    ON abs(t.cents) BETWEEN abs(i.cents) - {tol} AND abs(i.cents) + {tol}
   AND (i.invoice_date IS NULL OR (t.date >= i.invoice_date AND t.date - i.invoice_date <= {days}))
  WHERE i.cents IS NOT NULL)"""


BEST = """best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, date, row_idx, statement_id, tcents, description) AS rn
    FROM cand) WHERE rn = 1)"""

MATCH_SELECT = """SELECT i.filename, i.invoice_number, strftime(i.invoice_date, '%Y-%m-%d') AS invoice_date,
       CAST(i.cents AS DOUBLE) / 100 AS total_amount, b.k IS NOT NULL AS matched,
       round(b.score, 6) AS match_score, strftime(b.date, '%Y-%m-%d') AS bank_date,
       CAST(b.tcents AS DOUBLE) / 100 AS bank_amount, b.description AS bank_description
FROM inv_v i LEFT JOIN best b ON b.k = i.k"""

ORACLE: dict[str, str] = {}

ORACLE["match_best"] = f"WITH {INV_V},\n{TXN_V},\n{candidates_cte()},\n{BEST}\n{MATCH_SELECT}"

INV_O = f"""inv_o AS (
  SELECT o_orderkey AS k, 'ord_' || o_orderkey || '.pdf' AS filename, 'INV-' || o_orderkey AS invoice_number,
         CAST(o_orderdate AS DATE) AS invoice_date, {CENTS} AS cents
  FROM orders)"""

TXN_L = """txn_l AS (
  SELECT 'li' AS statement_id, l_orderkey * 8 + l_linenumber AS row_idx, CAST(l_shipdate AS DATE) AS date,
         'PAY INV-' || l_orderkey || ' P' || l_partkey AS description,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem)"""

OL = f"WITH {INV_O},\n{TXN_L},\n{candidates_cte('inv_o', 'txn_l', 500, 90)}"

ORACLE["join_amount_band"] = f"""WITH {INV_V},\n{TXN_V}
SELECT i.filename, t.row_idx AS bank_row_idx, abs(t.cents) - abs(i.cents) AS amount_diff_cents
FROM inv_v i JOIN txn_v t ON abs(t.cents) BETWEEN abs(i.cents) - 2 AND abs(i.cents) + 2
WHERE i.cents IS NOT NULL"""

ORACLE["join_date_window"] = f"""{OL}
SELECT i.filename, c.row_idx AS bank_row_idx, strftime(c.date, '%Y-%m-%d') AS bank_date,
       CAST(c.tcents AS DOUBLE) / 100 AS bank_amount, round(c.score, 6) AS match_score
FROM cand c JOIN inv_o i ON i.k = c.k"""

ORACLE["argmax_best"] = f"""{OL},\n{BEST}
SELECT i.filename, i.invoice_number, strftime(i.invoice_date, '%Y-%m-%d') AS invoice_date,
       CAST(i.cents AS DOUBLE) / 100 AS total_amount, b.k IS NOT NULL AS matched,
       round(b.score, 6) AS match_score, strftime(b.date, '%Y-%m-%d') AS bank_date,
       CAST(b.tcents AS DOUBLE) / 100 AS bank_amount, b.description AS bank_description
FROM inv_o i LEFT JOIN best b ON b.k = i.k"""

ORACLE["match_ambiguity"] = f"""{OL}
SELECT i.filename, count(c.k) AS n_candidates FROM inv_o i LEFT JOIN cand c ON c.k = i.k GROUP BY i.filename"""

ORACLE["rank_candidates"] = f"""{OL}
SELECT i.filename, c.row_idx AS bank_row_idx, round(c.score, 6) AS match_score,
       strftime(c.date, '%Y-%m-%d') AS bank_date, c.tcents AS bank_cents, c.description AS bank_description,
       c.statement_id AS bank_statement_id,
       row_number() OVER (PARTITION BY c.k ORDER BY c.score DESC, c.date, c.row_idx, c.statement_id,
                          c.tcents, c.description) AS rank
FROM cand c JOIN inv_o i ON i.k = c.k"""

ORACLE["pred_amount_tolerance"] = f"""WITH {INV_V},\n{TXN_V}
SELECT t.row_idx, coalesce(abs(abs(t.cents) - abs(i.cents)) <= 2, false) AS amount_ok
FROM txn_v t JOIN inv_v i ON i.k = t.row_idx"""

ORACLE["pred_date_window"] = f"""WITH {INV_V},\n{TXN_V}
SELECT t.row_idx, (i.invoice_date IS NULL OR (t.date >= i.invoice_date AND t.date - i.invoice_date <= 90)) AS date_ok
FROM txn_v t JOIN inv_v i ON i.k = t.row_idx"""

FLAG_BASE = f"WITH {INV_V},\n{TXN_V},\n{candidates_cte()},\n{BEST}"
USED_TX = """used AS (SELECT DISTINCT date, tcents, lower(regexp_replace(description, '\\s', '', 'g')) AS d FROM best)"""

ORACLE["mark_invoices"] = f"""{FLAG_BASE}
SELECT i.filename, b.k IS NOT NULL AS matched FROM inv_v i LEFT JOIN best b ON b.k = i.k"""

ORACLE["mark_transactions"] = f"""{FLAG_BASE},\n{USED_TX}
SELECT t.statement_id, t.row_idx, EXISTS (SELECT 1 FROM used u WHERE u.date = t.date AND u.tcents = t.cents
        AND u.d = lower(regexp_replace(t.description, '\\s', '', 'g'))) AS matched
FROM txn_v t"""

ORACLE["mark_stored_invoices"] = ORACLE["mark_invoices"]
ORACLE["mark_stored_transactions"] = ORACLE["mark_transactions"]

ORACLE["anti_transactions"] = f"""{FLAG_BASE},\n{USED_TX}
SELECT t.statement_id, t.row_idx FROM txn_v t WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.date = t.date
        AND u.tcents = t.cents AND u.d = lower(regexp_replace(t.description, '\\s', '', 'g')))"""

ORACLE["unmatched_invoices"] = f"""{FLAG_BASE}
SELECT i.filename FROM inv_v i LEFT JOIN best b ON b.k = i.k WHERE b.k IS NULL"""

ORACLE["summary_counts"] = f"""{FLAG_BASE},\n{USED_TX}
SELECT (SELECT count(*) FROM inv_v) AS invoices, (SELECT count(*) FROM best) AS invoices_matched,
       (SELECT count(*) FROM inv_v) - (SELECT count(*) FROM best) AS invoices_unmatched,
       (SELECT count(*) FROM txn_v) AS transactions,
       (SELECT count(*) FROM txn_v t WHERE EXISTS (SELECT 1 FROM used u WHERE u.date = t.date AND u.tcents = t.cents
          AND u.d = lower(regexp_replace(t.description, '\\s', '', 'g')))) AS transactions_used"""

ORACLE["sort_transactions"] = f"""WITH {TXN_V}
SELECT statement_id, row_idx, strftime(date, '%Y-%m-%d') AS date FROM txn_v ORDER BY date, statement_id, row_idx"""

FR_AMT = "translate(format('{:,.2f}', CAST({c} AS DOUBLE) / 100), ',.', ' ,')"


def fr_amt(cents_expr: str) -> str:
    return FR_AMT.replace("{c}", cents_expr)


ORD = f"""ord AS (SELECT o_orderkey AS k, o_custkey AS custkey, CAST(o_orderdate AS DATE) AS d, {CENTS} AS cents FROM orders)"""

SECTION = ("'Facture N° INV-' || k || chr(10) || 'SOCIETE SUP ' || (k % 100) || chr(10) || 'CLIENT CUS ' || custkey"
           " || chr(10) || 'Date de facture : ' || strftime(d, '%d/%m/%Y') || chr(10) || 'Total TTC : ' || "
           + fr_amt("cents") + " || ' EUR'")

SECS = f"""secs AS (
  SELECT k, 'doc_' || (k // 2) || '.pdf' AS src, row_number() OVER (PARTITION BY k // 2 ORDER BY k) AS section_no,
         count(*) OVER (PARTITION BY k // 2) AS n_sections, custkey, d, cents FROM ord)"""

ORACLE["split_sections"] = f"""WITH {ORD},\n{SECS}
SELECT CASE WHEN n_sections > 1 THEN src || '#' || section_no ELSE src END AS filename,
       CAST(section_no AS INTEGER) AS section_no, CAST(n_sections AS INTEGER) AS n_sections, {SECTION} AS text
FROM secs"""

ORACLE["split_sections_by_line"] = f"""WITH {ORD},
secs AS (SELECT k, 'doc_' || (k // 500) || '.pdf' AS src, row_number() OVER (PARTITION BY k // 500 ORDER BY k) AS section_no,
                count(*) OVER (PARTITION BY k // 500) AS n_sections, custkey, d, cents FROM ord)
SELECT CASE WHEN n_sections > 1 THEN src || '#' || section_no ELSE src END AS filename,
       CAST(section_no AS INTEGER) AS section_no, CAST(n_sections AS INTEGER) AS n_sections, {SECTION} AS text
FROM secs"""

ORACLE["extract_invoice_fields"] = f"""WITH {ORD},\n{SECS}
SELECT CASE WHEN n_sections > 1 THEN src || '#' || section_no ELSE src END AS filename,
       CAST(section_no AS INTEGER) AS section_no, 'INV-' || k AS invoice_number,
       strftime(d, '%Y-%m-%d') AS invoice_date, CAST(cents AS DOUBLE) / 100 AS total_amount, 'EUR' AS currency,
       'SOCIETE SUP ' || (k % 100) AS supplier_name, 'CLIENT CUS ' || custkey AS customer_name,
       replace({SECTION}, chr(10), ' | ') AS header_snippet
FROM secs"""

ORACLE["find_invoice_number"] = f"""WITH {ORD}
SELECT k, CASE WHEN k % 5 = 4 THEN NULL ELSE 'INV-' || k END AS invoice_number FROM ord"""

ORACLE["find_invoice_date"] = f"""WITH {ORD}
SELECT k, CASE WHEN k % 5 = 4 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS invoice_date FROM ord"""

ORACLE["find_total_amount"] = f"""WITH {ORD}
SELECT k, CAST(CASE WHEN k % 5 = 4 THEN cents - 1000 ELSE cents END AS DOUBLE) / 100 AS total_amount FROM ord
UNION ALL SELECT -k, CAST(cents // 100 AS DOUBLE) FROM ord"""

ORACLE["find_currency"] = f"""WITH {ORD}
SELECT k, 'EUR' AS currency, k % 4 <> 3 AS currency_detected FROM ord"""

ORACLE["infer_supplier"] = f"""WITH {ORD}
SELECT k, CASE WHEN k % 3 = 1 THEN 'CLIENT CUS ' || custkey ELSE 'SOCIETE SUP ' || (k % 100) END AS supplier_name
FROM ord"""

ORACLE["infer_customer"] = f"""WITH {ORD}
SELECT k, CASE WHEN k % 3 = 0 THEN 'CLIENT CUS ' || custkey
               ELSE 'Total TTC : ' || {fr_amt('cents')} || ' EUR' END AS customer_name
FROM ord"""

ORACLE["header_snippet"] = """SELECT doc_id, array_to_string(list_filter(list_transform(
         string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:6], ' | ') AS header_snippet
FROM documents"""

ORACLE["text_max_amount"] = """SELECT l_orderkey AS k, CAST(max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS max_amount
FROM lineitem GROUP BY l_orderkey"""

ORACLE["fn_parse_amount"] = f"""WITH {ORD}
SELECT k, CAST(CASE WHEN k % 3 = 0 THEN -cents ELSE cents END AS DOUBLE) / 100 AS amount FROM ord
UNION ALL SELECT -k, CAST(cents // 100 AS DOUBLE) FROM ord"""

ORACLE["fn_parse_date"] = f"""WITH {ORD}
SELECT k, CASE WHEN k % 5 = 4 THEN strftime(d, '%Y-%m-%d')
               WHEN k % 16 = 7 THEN NULL
               WHEN k % 8 = 1 THEN strftime(make_date(2000 + year(d) % 100, month(d), day(d)), '%Y-%m-%d')
               ELSE strftime(d, '%Y-%m-%d') END AS date FROM ord"""

ORACLE["fn_strip_accents"] = "SELECT doc_id, strip_accents(text) AS text FROM documents"

ORACLE["fn_std_header"] = """SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS std
FROM documents"""

ORACLE["score_levenshtein"] = f"""WITH {TXN_V}
SELECT row_idx, round({lev_score("('INV-' || ((row_idx * 7) % 10000))", 'description')}, 6) AS score FROM txn_v"""

ORACLE["score_partial_ratio_hit"] = f"""WITH {TXN_V}
SELECT row_idx, contains(lower(description), lower('INV-' || ((row_idx * 7) % 10000))) AS hit FROM txn_v"""

# ---------------------------------------------------------------- statements / sources


def std(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


HDR0 = """hdr0(sid, idx, header) AS (VALUES ('st_0',0,'Date'),('st_0',1,'Libellé'),('st_0',2,'Montant'),
  ('st_1',0,'Booking Date'),('st_1',1,'Label'),('st_1',2,'Débit'),('st_1',3,'Crédit'),
  ('st_2',0,'Date opération'),('st_2',1,'Narration'),('st_2',2,'Amount'),('st_2',3,'Debit'),('st_2',4,'Credit'),('st_2',5,'Solde'),
  ('st_3',0,'Valeur'),('st_3',1,'Détails'),('st_3',2,'Debit'),('st_3',3,'Credit'))"""

RULES = """rules(field, rank, cand) AS (VALUES ('date',0,'date'),('date',1,'date operation'),('date',2,'operation date'),
  ('date',3,'transaction date'),('date',4,'booking date'),('date',5,'valeur'),
  ('description',0,'description'),('description',1,'libelle'),('description',2,'label'),('description',3,'details'),
  ('description',4,'detail'),('description',5,'narration'),('amount',0,'montant'),('amount',1,'amount'),('amount',2,'montant eur'),
  ('amount',3,'debit/credit'),('amount',4,'debit credit'),('debit',0,'debit'),('debit',1,'retrait'),
  ('credit',0,'credit'),('credit',1,'versement'),('balance',0,'solde'))"""

COLUMN_RULES = f"""WITH {TXN_V},
{HDR0},
nh AS (SELECT sid, max(idx) AS top FROM hdr0 GROUP BY sid),
hv AS (
  SELECT t.row_idx AS k, h.idx - CASE WHEN (t.row_idx // 8) % 3 = 2 THEN 1 ELSE 0 END AS idx,
    CASE t.row_idx % 8 WHEN 1 THEN upper(header) WHEN 2 THEN lower(header) WHEN 3 THEN strip_accents(header)
      WHEN 4 THEN header || ' EUR' WHEN 5 THEN substr(header, 2) WHEN 6 THEN header || 's'
      WHEN 7 THEN '  ' || replace(header, ' ', '_') ELSE header END AS changed
  FROM txn_v t JOIN hdr0 h ON h.sid = t.statement_id JOIN nh ON nh.sid = h.sid
  WHERE NOT ((t.row_idx // 8) % 3 = 1 AND h.idx = nh.top) AND NOT ((t.row_idx // 8) % 3 = 2 AND h.idx = 0)),
hn AS (SELECT k, idx, changed || CASE WHEN idx = 0 AND k % 7 = 0 THEN ' ' || (k % 101) ELSE '' END AS header FROM hv),
lay AS (SELECT k, string_agg(header, '|' ORDER BY idx) AS layout FROM hn GROUP BY k),
hl AS (SELECT DISTINCT l.layout, hn.idx, hn.header FROM hn JOIN lay l USING (k)),
{RULES},
p AS (SELECT hl.layout, hl.idx, r.field, r.rank, r.cand, {std('hl.header')} AS std FROM hl CROSS JOIN rules r),
p2 AS (SELECT *, std = cand AS exact, std <> '' AND contains(std, cand) AS cont,
              jaro_winkler_similarity(std, cand) AS jw FROM p),
claims AS (SELECT layout, field AS cf, arg_min(idx, rank * 1000 + idx) AS cidx FROM p2 WHERE exact GROUP BY layout, field),
free AS (SELECT * FROM p2 WHERE NOT EXISTS (
          SELECT 1 FROM claims c WHERE c.layout = p2.layout AND c.cidx = p2.idx AND c.cf <> p2.field)),
jwr AS (SELECT layout, field, idx AS jw_idx FROM (
          SELECT *, row_number() OVER (PARTITION BY layout, field ORDER BY jw DESC, idx, rank) AS rn FROM free)
        WHERE rn = 1),
best AS (SELECT layout, field, arg_min(idx, rank * 1000 + idx) FILTER (WHERE exact) AS exact_idx,
                min(idx) FILTER (WHERE cont) AS contains_idx, max(jw) AS jw_best
         FROM free GROUP BY layout, field),
bj AS (SELECT b.*, j.jw_idx FROM best b JOIN jwr j USING (layout, field))"""

# DuckDB drops the half of an odd transposition count that the Jaro part keeps here, which shows in headers with
# numbers; similarities are compared on headers without them.
ORACLE["header_best_match"] = f"""{COLUMN_RULES}
SELECT layout, field, CAST(exact_idx AS INTEGER) AS exact_idx, CAST(contains_idx AS INTEGER) AS contains_idx,
       CAST(jw_idx AS INTEGER) AS jw_idx, round(jw_best, 6) AS jw_best FROM bj"""

ORACLE["detect_columns"] = f"""{COLUMN_RULES},
ch AS (SELECT layout, field, coalesce(exact_idx, contains_idx, CASE WHEN jw_best >= 0.85 THEN jw_idx END) AS c FROM bj),
w AS (SELECT layout, max(c) FILTER (WHERE field = 'date') AS d, max(c) FILTER (WHERE field = 'description') AS s,
             max(c) FILTER (WHERE field = 'amount') AS a, max(c) FILTER (WHERE field = 'debit') AS db,
             max(c) FILTER (WHERE field = 'credit') AS cr, max(c) FILTER (WHERE field = 'balance') AS bal
      FROM ch GROUP BY layout),
w2 AS (SELECT *, coalesce(a, CASE WHEN db IS NULL AND cr IS NULL THEN bal END) AS amt FROM w)
SELECT layout, CAST(d AS INTEGER) AS date_idx, CAST(s AS INTEGER) AS description_idx, CAST(amt AS INTEGER) AS amount_idx,
       CAST(db AS INTEGER) AS debit_idx, CAST(cr AS INTEGER) AS credit_idx,
       CASE WHEN d IS NULL THEN 'no date column' WHEN s IS NULL THEN 'no description column'
            WHEN amt IS NULL AND db IS NULL AND cr IS NULL THEN 'no amount column' END AS reject_reason
FROM w2"""

ORACLE["resolve_suggested_column"] = f"""WITH {TXN_V},\n{HDR0},
s AS (SELECT statement_id, row_idx, (['Date', 'libelle', 'Montant EUR', 'debit', 'xyz', ''])[row_idx % 6 + 1] AS sug FROM txn_v),
p AS (SELECT s.statement_id, s.row_idx, s.sug, h.idx, h.header, {std('h.header')} AS hs, {std('s.sug')} AS ts
      FROM s JOIN hdr0 h ON h.sid = s.statement_id),
p2 AS (SELECT *, jaro_winkler_similarity(hs, ts) AS jw,
              row_number() OVER (PARTITION BY statement_id, row_idx ORDER BY jaro_winkler_similarity(hs, ts) DESC, idx) AS rn
       FROM p),
r AS (SELECT statement_id, row_idx, any_value(sug) AS sug, min(idx) FILTER (WHERE hs = ts) AS eq,
             max(jw) AS jwb, min(idx) FILTER (WHERE rn = 1) AS jwi
      FROM p2 GROUP BY statement_id, row_idx),
r2 AS (SELECT *, CASE WHEN trim(sug) = '' THEN NULL ELSE coalesce(eq, CASE WHEN jwb >= 0.75 THEN jwi END) END AS ri FROM r)
SELECT r2.statement_id, r2.row_idx, h.header AS resolved
FROM r2 LEFT JOIN hdr0 h ON h.sid = r2.statement_id AND h.idx = r2.ri"""

TX_OUT = "statement_id, row_idx, strftime(date, '%Y-%m-%d') AS date, description, CAST(cents AS DOUBLE) / 100 AS amount"

ORACLE["harmonise_statements"] = f"WITH {TXN_V}\nSELECT {TX_OUT} FROM txn_v"

ORACLE["signed_amount"] = f"""WITH {TXN_V}
SELECT statement_id, row_idx, CASE WHEN cents <> 0 OR statement_id IN ('st_0', 'st_2') THEN CAST(cents AS DOUBLE) / 100 END AS amount
FROM txn_v"""

ORACLE["filter_valid_tx"] = f"""WITH {TXN_V}
SELECT {TX_OUT} FROM txn_v WHERE NOT (row_idx % 19 = 0 OR row_idx % 23 = 0 OR row_idx % 29 = 0)"""

ORACLE["agg_reject_report"] = f"""WITH {TXN_V}
SELECT statement_id, count(*) AS rows_in,
       count(*) FILTER (WHERE NOT (row_idx % 19 = 0 OR row_idx % 23 = 0 OR row_idx % 29 = 0)) AS rows_kept,
       CAST(0 AS BIGINT) AS dropped_layout,
       count(*) FILTER (WHERE row_idx % 19 = 0) AS dropped_no_date,
       count(*) FILTER (WHERE row_idx % 19 <> 0 AND row_idx % 23 = 0) AS dropped_no_description,
       count(*) FILTER (WHERE row_idx % 19 <> 0 AND row_idx % 23 <> 0 AND row_idx % 29 = 0) AS dropped_no_amount
FROM txn_v GROUP BY statement_id"""

EN_AMT = "format('{:,.2f}', CAST({c} AS DOUBLE) / 100)"

CELLS_V = f"""cells_v AS (
  SELECT statement_id, row_idx,
    CASE statement_id WHEN 'st_0' THEN 'Date|Libellé|Montant' WHEN 'st_1' THEN 'Booking Date|Label|Débit|Crédit'
      WHEN 'st_2' THEN 'Date opération|Narration|Amount|Debit|Credit|Solde' ELSE 'Valeur|Détails|Debit|Credit' END AS headers,
    CASE statement_id
      WHEN 'st_0' THEN strftime(date, '%d/%m/%Y') || '|' || description || '|' || {fr_amt('cents')}
      WHEN 'st_2' THEN strftime(date, '%d/%m/%Y') || '|' || description || '|'
           || CASE WHEN row_idx % 5 <> 0 THEN {EN_AMT.replace('{c}', 'cents')} ELSE '' END || '|'
           || CASE WHEN row_idx % 5 = 0 AND cents < 0 THEN {fr_amt('abs(cents)')} ELSE '' END || '|'
           || CASE WHEN row_idx % 5 = 0 AND cents > 0 THEN {fr_amt('abs(cents)')} ELSE '' END || '|0,00'
      ELSE strftime(date, '%Y-%m-%d') || '|' || description || '|'
           || CASE WHEN cents < 0 THEN {fr_amt('abs(cents)')} ELSE '' END || '|'
           || CASE WHEN cents > 0 THEN {fr_amt('abs(cents)')} ELSE '' END END AS cells
  FROM txn_v)"""

ORACLE["src_grid_header"] = f"""WITH {TXN_V},\n{CELLS_V}
SELECT statement_id, row_idx + 11 AS row_idx, headers, cells FROM cells_v"""

ORACLE["src_csv_sniff"] = f"""WITH {TXN_V},\n{CELLS_V}
SELECT statement_id, row_idx * 2 + 2 AS row_idx, headers,
       CASE WHEN statement_id = 'st_3' AND row_idx % 6 = 0 THEN replace(cells, 'VIR ', 'VIR' || chr(10))
            WHEN statement_id <> 'st_3' AND row_idx % 3 = 1 THEN replace(cells, 'VIR ', 'VIR 5" ') ELSE cells END AS cells
FROM cells_v"""

ORACLE["src_csv_yield"] = f"""WITH {TXN_V},\n{CELLS_V}
SELECT statement_id, row_idx * 2 + 2 AS row_idx,
       CASE statement_id WHEN 'st_0' THEN replace(headers, 'Libell\u00e9', 'Libell\u00e9, d\u00e9tail, suite')
            ELSE replace(headers, 'Label', 'Label; a|b|c, d') END AS headers,
       CASE WHEN row_idx % 3 = 1 THEN replace(cells, 'VIR ', 'VIR 5" ') ELSE cells END AS cells
FROM cells_v WHERE statement_id IN ('st_0', 'st_1')"""

ORACLE["src_statement_lines"] = f"""WITH {TXN_V}
SELECT {TX_OUT} FROM txn_v WHERE row_idx % 10 <> 0
UNION ALL SELECT 'w_' || statement_id, row_idx, strftime(date, '%Y-%m-%d'), description, CAST(sign(cents) * (abs(cents) // 100) AS DOUBLE)
FROM txn_v"""

ORACLE["src_route_format"] = """SELECT 'f' || o_orderkey || (['.PDF', '.csv', '.XLSX', '.xls', '.txt'])[o_orderkey % 5 + 1] AS filename,
       CASE o_orderkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' WHEN 2 THEN 'excel' WHEN 3 THEN 'excel' END AS format,
       CASE WHEN o_orderkey % 5 = 4 THEN 'unsupported format: f' || o_orderkey || '.txt' END AS reject_reason
FROM orders"""

_TX_G = TX_OUT.replace("description,", "description || CASE WHEN row_idx % 2 = 1 THEN ' G' ELSE '' END AS description,")
ORACLE["set_union_sources"] = f"""WITH {TXN_V}
SELECT {_TX_G}, 'grid' AS row_source FROM txn_v WHERE statement_id IN ('st_0', 'st_1')
UNION ALL
SELECT {TX_OUT}, 'lines' AS row_source FROM txn_v
WHERE row_idx % 10 <> 0 AND (statement_id NOT IN ('st_0', 'st_1') OR row_idx % 2 = 1)"""

ORACLE["src_page_concat"] = """SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text, count(*) AS n_pages
FROM conversations GROUP BY conv_id"""

# ---------------------------------------------------------------- model answers

RESP_V = f"""resp_v AS (
  SELECT k, filename, invoice_number, invoice_date, cents,
    CASE WHEN k % 6 = 0 THEN '{{"facture":' ELSE '' END
    || '{{"invoice_number":' || CASE WHEN k % 5 = 0 THEN 'null' ELSE '"LLM-' || k || '"' END
    || ',"invoice_date":"' || coalesce(strftime(invoice_date, '%Y-%m-%d'), '')
    || '","total_amount":' || CASE WHEN cents IS NOT NULL AND k % 4 = 2 THEN CAST(CAST(cents AS DECIMAL(20, 0)) / 100 AS DECIMAL(18, 2))::VARCHAR
                                   ELSE '"' || coalesce({fr_amt('cents')}, '') || '"' END || ',"currency":"eur"}}' || CASE WHEN k % 6 = 0 THEN '}}' ELSE '' END AS js
  FROM inv_v)"""

ORACLE["json_block"] = f"WITH {INV_V},\n{RESP_V}\nSELECT k, CASE WHEN k % 2 = 0 THEN js END AS block FROM resp_v"

ORACLE["json_invoice_fields"] = f"""WITH {INV_V}
SELECT k, CASE WHEN k % 2 = 0 AND k % 5 <> 0 THEN 'LLM-' || k END AS llm_invoice_number,
       CASE WHEN k % 2 = 0 THEN strftime(invoice_date, '%Y-%m-%d') END AS llm_invoice_date,
       CASE WHEN k % 2 = 0 THEN CAST(cents AS DOUBLE) / 100 END AS llm_total_amount,
       CASE WHEN k % 2 = 0 THEN 'EUR' END AS llm_currency
FROM inv_v
UNION ALL SELECT -o_orderkey, NULL, NULL, CASE WHEN o_orderkey % 2 = 0 THEN CAST(({CENTS} % 999000 + 5) // 10 AS DOUBLE) / 100
                                               ELSE CAST({CENTS} // 100 AS DOUBLE) END, NULL FROM orders"""

ORACLE["json_transactions"] = f"""WITH {TXN_V},
items AS (SELECT *, statement_id || '#' || (row_idx // 10) AS sid,
                 row_number() OVER (PARTITION BY statement_id, row_idx // 10 ORDER BY row_idx) - 1 AS pos FROM txn_v)
SELECT sid AS statement_id, pos AS row_idx, strftime(date, '%Y-%m-%d') AS date, description,
       CAST(cents AS DOUBLE) / 100 AS amount
FROM items WHERE row_idx % 4 <> 3"""

ORACLE["overlay_enrichment"] = f"""WITH {INV_V}
SELECT filename, CASE WHEN k % 2 = 0 AND k % 5 <> 0 THEN 'LLM-' || k ELSE invoice_number END AS invoice_number,
       strftime(invoice_date, '%Y-%m-%d') AS invoice_date, CAST(cents AS DOUBLE) / 100 AS total_amount,
       'EUR' AS currency
FROM inv_v"""

# ---------------------------------------------------------------- sinks


def xml_field(name: str, expr: str) -> str:
    esc = f"replace(replace(replace({expr}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return (f"CASE WHEN coalesce({expr}, '') = '' THEN '    <{name}/>' || chr(10) "
            f"ELSE '    <{name}>' || {esc} || '</{name}>' || chr(10) END")


ORACLE["sink_xml_rows"] = f"""WITH {INV_V}
SELECT '  <invoice>' || chr(10) || {xml_field('filename', "(filename || '&<x>')")}
       || {xml_field('invoice_number', 'invoice_number')}
       || {xml_field('invoice_date', "strftime(invoice_date, '%Y-%m-%d')")}
       || {xml_field('total_amount', "printf('%.2f', CAST(cents AS DOUBLE) / 100)")}
       || {xml_field('currency', "'EUR'")} || '  </invoice>' AS xml
FROM inv_v"""

MATCH_ROWS = f"""{FLAG_BASE},
mr AS (SELECT i.filename, i.invoice_number, strftime(i.invoice_date, '%Y-%m-%d') AS invoice_date,
              printf('%.2f', CAST(i.cents AS DOUBLE) / 100) AS total_amount,
              CASE WHEN b.k IS NOT NULL THEN 'true' ELSE 'false' END AS matched,
              printf('%.6f', round(b.score, 6)) AS match_score, strftime(b.date, '%Y-%m-%d') AS bank_date,
              printf('%.2f', CAST(b.tcents AS DOUBLE) / 100) AS bank_amount, b.description AS bank_description
       FROM inv_v i LEFT JOIN best b ON b.k = i.k)"""

_MCOLS = ["filename", "invoice_number", "invoice_date", "total_amount", "matched", "match_score", "bank_date",
          "bank_amount", "bank_description"]

ORACLE["sink_csv_rows"] = f"""{MATCH_ROWS}
SELECT {" || ',' || ".join(f"coalesce({c}, '')" for c in _MCOLS)} AS line FROM mr"""


def _json_member(c: str, first: bool) -> str:
    quoted = c not in ("total_amount", "matched", "match_score", "bank_amount")
    val = f"'\"' || {c} || '\"'" if quoted else c
    lead = "" if first else ","
    return f"CASE WHEN {c} IS NOT NULL THEN '{lead}\"{c}\":' || {val} ELSE '' END"


ORACLE["sink_json_rows"] = f"""{MATCH_ROWS}
SELECT '{{' || {" || ".join(_json_member(c, i == 0) for i, c in enumerate(_MCOLS))} || '}}' AS json FROM mr"""

INV_X = f"""inv_x AS (
  SELECT k, 'doc_' || (k // 2) || '.pdf' || CASE WHEN count(*) OVER (PARTITION BY k // 2) > 1
           THEN '#' || row_number() OVER (PARTITION BY k // 2 ORDER BY k) ELSE '' END AS filename,
         'INV-' || k AS invoice_number, d AS invoice_date, cents, custkey FROM ord)"""

ORACLE["summary_invoices"] = f"""WITH {ORD},\n{INV_X},\n{TXN_V},
txn_l10 AS (SELECT * FROM txn_v WHERE row_idx % 10 <> 0),
{candidates_cte('inv_x', 'txn_l10', 2, 90)},\n{BEST}
SELECT i.filename, i.invoice_number, strftime(i.invoice_date, '%Y-%m-%d') AS invoice_date,
       CAST(i.cents AS DOUBLE) / 100 AS total_amount, 'EUR' AS currency, 'SOCIETE SUP ' || (i.k % 100) AS supplier_name,
       'CLIENT CUS ' || i.custkey AS customer_name, b.k IS NOT NULL AS matched
FROM inv_x i LEFT JOIN best b ON b.k = i.k"""


# The same column suggestions as the Spark query (NULL = JSON null or blank).
_SUGGESTIONS = [
    ("Date", "Libellé", "Montant", None, None),
    ("booking date", "label", None, "Débit", "Crédit"),
    ("Date opération", "Description", "Amount", None, None),
    (None, "Détails", None, "Debit", "Credit"),
]
_CKEYS = ["date_column", "description_column", "amount_column", "debit_column", "credit_column"]


def _suggestion(i: int) -> str:
    whens = " ".join(f"WHEN {n} THEN " + ("NULL" if s[i] is None else f"'{s[i]}'")
                     for n, s in enumerate(_SUGGESTIONS))
    return f"CASE row_idx % 4 {whens} END AS {_CKEYS[i]}"


ORACLE["json_column_map"] = f"""WITH {TXN_V}
SELECT statement_id, row_idx, {", ".join(_suggestion(i) for i in range(5))} FROM txn_v"""


_KEYED_CAND = candidates_cte().replace(
    "   AND (i.invoice_date IS NULL", "   AND t.statement_id = 'st_' || (i.o_custkey % 4)\n   AND (i.invoice_date IS NULL")
ORACLE["match_keyed"] = f"WITH {INV_V},\n{TXN_V},\n{_KEYED_CAND},\n{BEST}\n{MATCH_SELECT}"

# salting must not change the result: same SQL as the plain best match
ORACLE["match_salted"] = ORACLE["match_best"]

_ODD = "statement_id IN ('st_0', 'st_1', 'st_3')"  # st_2's answer names no column of its own
ORACLE["harmonise_suggested"] = f"WITH {TXN_V}\nSELECT {TX_OUT} FROM txn_v WHERE {_ODD}"

ORACLE["reconcile_rejects"] = f"""WITH {TXN_V},
st AS (SELECT DISTINCT statement_id FROM txn_v)
SELECT statement_id, 'no date column' AS reason, CAST(0 AS BIGINT) AS rows FROM st WHERE statement_id = 'st_2'
UNION ALL SELECT 'blank_' || statement_id, 'no separator', 0 FROM st
UNION ALL SELECT 'bare_' || statement_id, 'no header row', 0 FROM st
UNION ALL SELECT 'head_' || statement_id, 'no row below the header', 0 FROM st
UNION ALL SELECT 'empty_' || statement_id || '.csv', 'empty file', 0 FROM st
UNION ALL SELECT 'doc_' || statement_id || '.odt', 'unsupported format: doc_' || statement_id || '.odt', 0 FROM st
UNION ALL SELECT 'from grid', NULL, (SELECT count(*) FROM txn_v WHERE {_ODD})
UNION ALL SELECT 'from lines', NULL, (SELECT count(*) FROM txn_v WHERE row_idx % 10 <> 0)
UNION ALL SELECT 'from answers', NULL, (SELECT count(*) FROM txn_v WHERE row_idx % 4 <> 3)"""

_FAR = """txn_f AS (SELECT * FROM txn_v UNION ALL
  SELECT 'far', max(row_idx) + 1, DATE '9999-12-31', 'FAR', 100 FROM txn_v)"""
ORACLE["match_repeated_names"] = f"WITH {INV_V},\n{TXN_V},\n{_FAR},\n{candidates_cte('inv_v', 'txn_f')},\n{BEST}\n" \
    + MATCH_SELECT.replace("i.filename,", "'inv_' || (i.k // 3) || '.pdf' AS filename,")
