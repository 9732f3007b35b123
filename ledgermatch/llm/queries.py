"""Registered queries of the operators, and DuckDB SQL where SQL can state the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_piece_codec(spark, sf_dir):
    """SentencePiece ids and decoded text of every document, as digests."""
    from .piece_codec import transcode
    return transcode(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                     ("n_tokens", "ids_sha256", "decoded_sha256"), carry=("doc_id",))


@query
def op8_token_store(spark, sf_dir):
    """Write every document's ids (end id 2) as Parquet in doc_id order, read the files back, return their digests."""
    from .token_store import digest_tokens, write_tokens
    path = shared_path(spark, "tokens")
    write_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=2)
    return digest_tokens(spark, path)


@query
def op2_decontaminate(spark, sf_dir):
    """Words of every document inside occurrences of benchmark windows, and whether they contaminate it."""
    from .decontaminate import contamination, items_digest
    found = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", items_digest().alias("items_sha256"), "contaminated")


@query
def op10_shard_shuffle(spark, sf_dir):
    """Uniform shuffle of all documents into 8 shards whose row counts differ by one at most."""
    from .shard_shuffle import shuffle_into_shards
    shuffled = shuffle_into_shards(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), 8, seed=17)
    data = F.col("text").cast("binary")
    return shuffled.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                           F.coalesce(F.crc32(data), F.lit(0)).cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
                           F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
                           F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_quality_rules(spark, sf_dir):
    """Base rules and a learned decision list over statistics of every whole text."""
    from .quality_rules import judge, learn
    docs = table(spark, sf_dir, "documents")
    judged = judge(docs, learn(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept")


@query
def op4_license_scan(spark, sf_dir):
    """License phrases and template joins of every whole text."""
    from .license_scan import scan_licenses
    return scan_licenses(spark, table(spark, sf_dir, "documents"), carry=["doc_id"])


@query
def op7_language_id(spark, sf_dir):
    """Predicted language of every whole text."""
    from .language_id import fit, held_out, identify
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    found = identify(spark, docs.select("doc_id", "text", held_out().alias("held_out")), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_toxicity(spark, sf_dir):
    """Toxicity score of every whole text."""
    from .toxicity import fit, score_toxicity, training_fold
    docs = table(spark, sf_dir, "documents")
    model = fit(spark, docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", (~training_fold()).alias("held_out"))
    return score_toxicity(spark, rows, model, ["doc_id", "held_out"])


@query
def op5_quality_knn(spark, sf_dir):
    """Quality score of every whole text."""
    from .quality_knn import fit, score_quality, training_fold
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_quality(spark, docs.select("doc_id", "text", (~training_fold()).alias("held_out")), model,
                         ["doc_id", "held_out"])


@query
def op1_jaccard_join(spark, sf_dir):
    """Class and number of links of every document at 5-word Jaccard similarity 0.8."""
    from .jaccard_join import jaccard_join
    return jaccard_join(spark, table(spark, sf_dir, "documents"))


@query
def op11_whitening(spark, sf_dir):
    """Whitened components of every embedding."""
    from .whitening import component_rows, fit_whitening, whiten
    vectors = table(spark, sf_dir, "embeddings")
    model = fit_whitening(spark, vectors)
    return component_rows(whiten(spark, vectors, model, carry=["vec_id"]), model).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query
def op12_prefix_trie(spark, sf_dir):
    """Nodes of the trie of all rebuilt conversations, with totals over their subtrees."""
    from .prefix_trie import prefix_trie, rebuilt
    turns, convs = rebuilt(table(spark, sf_dir, "conversations"))
    return prefix_trie(turns, convs).drop("x1", "x2")


@query
def op13_source_mix(spark, sf_dir):
    """Words that a mix of all documents at the target weights takes of each."""
    from .source_mix import mix_sources
    mixed = mix_sources(spark, table(spark, sf_dir, "documents"), seed=13)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op2_decontaminate"] = f"""WITH dw AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORD}) AS w FROM documents),
iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOW}, {_WORD}) AS w FROM benchmark),
iv AS (SELECT item, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS pos FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS t FROM iv),
sizes AS (SELECT DISTINCT n FROM win),
dv AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS pos FROM dw, sizes WHERE len(w) >= n),
dt AS (SELECT doc_id, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS t FROM dv),
hits AS (SELECT dt.doc_id, dt.n, dt.pos, win.item FROM dt JOIN win ON win.n = dt.n AND win.t = dt.t),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hw.n_hit, 0) AS n_hit, coalesce(hi.n_items, 0) AS n_items,
       sha256(coalesce(hi.items, '')) AS items_sha256,
       coalesce(hw.n_hit, 0) > 0 AND 20 * coalesce(hw.n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id"""

# Every block of every source is listed here, and every quotient is ranked; the query lists neither.
ORACLE["op13_source_mix"] = r"""WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(chr(31), '13', coalesce('+' || CAST(doc_id AS VARCHAR), '-'), coalesce('+' || text, '-'))) AS key
  FROM documents),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized),
src AS (SELECT source, source_size, number, CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM weighed),
rounds(n, stopped, all2) AS (
  SELECT 0, CAST([] AS BIGINT[]), (SELECT CAST(3 * sum(source_size) AS BIGINT) FROM src)
  UNION ALL
  SELECT n + 1, (SELECT list(number ORDER BY number) FROM src, (
      SELECT r.all2 - coalesce(sum(4 * source_size) FILTER (list_contains(r.stopped, number)), 0) AS rest,
             coalesce(sum(weight) FILTER (NOT list_contains(r.stopped, number)), 0) AS open FROM src)
    WHERE list_contains(r.stopped, number) OR 4 * source_size * open <= weight * rest), all2
  FROM rounds r WHERE n < (SELECT count(*) FROM src)),
final AS (SELECT stopped, all2 FROM rounds ORDER BY n DESC LIMIT 1),
level AS (SELECT all2 - coalesce((SELECT sum(4 * source_size) FROM src WHERE list_contains(stopped, number)), 0) AS rest,
    coalesce((SELECT sum(weight) FROM src WHERE NOT list_contains(stopped, number)), 0) AS open, stopped FROM final),
goal AS (SELECT source, source_size, number, (source_size + 63) // 64 AS n_blocks,
    CASE WHEN list_contains(stopped, number) THEN CAST(2 * source_size AS DOUBLE)
         ELSE CAST(weight * rest AS DOUBLE) / CAST(2 * open AS DOUBLE) END AS target FROM src, level),
seat AS (SELECT *, CASE WHEN source_size > 0 THEN target * n_blocks / source_size ELSE 0 END AS seats FROM goal),
house AS (SELECT CAST(round(sum(seats)) AS BIGINT) AS blocks FROM seat),
quotient AS (SELECT number, k, seats / (2 * k + 1) AS q FROM seat, unnest(range(0, 2 * n_blocks)) AS t(k) WHERE seats > 0),
taken_blocks AS (SELECT number, count(*) AS quota FROM (
    SELECT number FROM quotient ORDER BY q DESC, number, k LIMIT (SELECT blocks FROM house)) GROUP BY number),
deal AS (SELECT seat.*, coalesce(quota, 0) AS quota,
    CASE WHEN n_blocks % 99991 <> 0 THEN 99991 WHEN n_blocks % 99989 <> 0 THEN 99989 ELSE 99971 END AS stride,
    CAST('0x' || substr(md5(concat_ws(chr(31), '13', '+offset', coalesce('+' || source, '-'))), 1, 8) AS BIGINT) AS shift
  FROM seat LEFT JOIN taken_blocks USING (number)),
blocks AS (SELECT number, k * (source_size // n_blocks) + least(k, source_size % n_blocks) AS a,
    (k + 1) * (source_size // n_blocks) + least(k + 1, source_size % n_blocks) AS b,
    CAST((shift % n_blocks + (stride % n_blocks) * k) % n_blocks < quota AS INTEGER)
    + CAST(n_blocks + (shift % n_blocks + (stride % n_blocks) * k) % n_blocks < quota AS INTEGER) AS times
  FROM deal, unnest(range(0, n_blocks)) AS t(k)),
placed AS (SELECT d.doc_id, d.size, d.source, d.key, g.number, g.source_size, g.target,
    sum(d.size) OVER (PARTITION BY g.number ORDER BY d.key ROWS UNBOUNDED PRECEDING) - d.size AS pos
  FROM docs d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
numbered AS (SELECT *, row_number() OVER () AS id FROM placed)
SELECT any_value(p.doc_id) AS doc_id, any_value(p.size) AS size, any_value(p.source_size) AS source_size,
       any_value(p.target) AS target,
       CAST(coalesce(sum(times * greatest(least(b, pos + size) - greatest(a, pos), 0)), 0) AS BIGINT) AS taken
FROM numbered p LEFT JOIN blocks ON blocks.number = p.number AND b > pos AND a < pos + size GROUP BY p.id"""

_BYTE = "list_concat([ascii(c)], [-1, -1, -1, -1, -1, -1, -1, -1])"  # a byte, then its eight shifts
ORACLE["op12_prefix_trie"] = rf"""WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, CAST(xor(list_reduce(list_concat([4294967295], CAST(flatten(list_transform(
    string_split(CAST(conv_id AS VARCHAR), ''), lambda c: {_BYTE})) AS BIGINT[])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS BIGINT) AS h FROM turns),
built AS (
  SELECT i.conv_id, t.place AS depth, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 20 AND t.place <= i.h
  UNION ALL
  SELECT i.conv_id, t.place - i.h + (SELECT count(*) FROM turns b WHERE b.conv_id = i.conv_id - i.conv_id % 20 AND b.place <= i.h), t.role, t.text
  FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.place > i.h),
paths AS (SELECT conv_id, depth, text, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM built
  UNION ALL SELECT conv_id, 0, '', '' FROM ids),
lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(text), '[^ 	-
]+')), 0) AS saved,
    left(path, len(path) - 64) AS parent FROM paths GROUP BY path, depth),
kids AS (SELECT parent, count(*) AS n FROM node WHERE depth > 0 GROUP BY parent),
sums AS (SELECT a.path, sum(b.saved) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM node a JOIN node b ON starts_with(b.path, a.path) LEFT JOIN kids k ON k.parent = b.path GROUP BY a.path),
done AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends
  FROM paths JOIN lengths USING (conv_id) WHERE depth = length GROUP BY path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, CASE WHEN n.depth > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs,
       coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(d.ends, '')) AS ends_sha256
FROM node n JOIN sums s ON s.path = n.path LEFT JOIN node p ON p.path = n.parent AND p.depth = n.depth - 1
LEFT JOIN kids k ON k.parent = n.path LEFT JOIN done d ON d.path = n.path"""
