"""Delimited statements with separator sniffing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import ktrim
from ..operators.once import evaluate_once
from ..operators.statements import drop_reason, harmonise
from ..session import checkpoint_dir

# Separators tried in this order; the first that splits the
# header line into more than one field wins.
SEPARATORS = [",", ";", "\t", "|"]
_REGEX_SEP = {",": ",", ";": ";", "\t": "\\t", "|": "\\|"}
_BLANKS = r"[ \u00a0\u202f]*+"
_QUOTED = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$'
#: Lines (numbers of lines, bytes in files) of one run of the quote states, and
#: the most that one record may span; a longer one is taken as plain lines.
RUN_LINES = 1 << 20
RECORD_SPAN = 1 << 16
#: Numbers of lines (bytes in files) that meet their statement's header in one group.
PART_LINES = 1 << 18
#: Lines after the header that decide between separators, where more than one splits it.
HEAD_LINES = 20


def _quoted(sep: str) -> str:
    """A field in quotes, as a pattern: a quote opens at the field's start
    only, a doubled one is text, and what follows the closing one up to the
    separator belongs to the field."""
    return rf'{_BLANKS}"[^"]*+(?:""[^"]*+)*+"[^{_REGEX_SEP[sep]}]*+'


def split_fields(line, sep: str) -> Column:
    """CSV fields of one record for a fixed separator: trimmed, surrounding
    quotes removed and doubled quotes undone. Quotes inside a field (``5"``)
    and quotes that nothing closes are plain text.

    Records without quotes, nearly all, are one plain split; the others one
    search per field. Linear in the text."""
    c = F.col(line) if isinstance(line, str) else line
    s = _REGEX_SEP[sep]
    plain = F.transform(F.split(c, s), ktrim)
    found = F.regexp_extract_all(F.concat(c, F.lit(sep)), F.lit(f"({_quoted(sep)}|[^{s}]*+){s}"), F.lit(1))

    def unquote(t):
        body = F.replace(F.regexp_extract(t, _QUOTED, 1), F.lit('""'), F.lit('"'))
        return F.when(F.rlike(t, F.lit(_QUOTED)), F.concat(body, F.regexp_extract(t, _QUOTED, 2))).otherwise(t)
    return F.when(F.contains(c, F.lit('"')), F.transform(F.transform(found, ktrim), unquote)).otherwise(plain)


def read_statement_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files -> (statement_id = full path, file_name, line_no, line).

    Files are read in splits. ``line_no`` is the split's first byte plus the
    line's place in the split: unique and ascending in a file, since a line
    takes at least one byte."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("statement_id"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_seq"),
        F.regexp_replace("value", "\r", "").alias("line"))
    split = Window.partitionBy("statement_id", "_at").orderBy("_seq")  # at most one split's lines
    return raw.withColumn("line_no", F.col("_at") + F.row_number().over(split) - 1) \
        .select("statement_id", "file_name", "line_no", "line")


def _part() -> Column:
    return F.expr(f"line_no div {PART_LINES}")


def _below(lines: DataFrame, heads: DataFrame, *cols: str) -> DataFrame:
    """Lines below their statement's header, with ``header_no`` and ``cols`` of
    ``heads``. A header is copied to the ranges of line numbers (``parts``) that
    its statement has, so that a long statement is many tasks in the join."""
    spread = heads.select("statement_id", "header_no", *cols, F.explode("parts").alias("_part"))
    return lines.withColumn("_part", _part()).join(spread, ["statement_id", "_part"]) \
        .where(F.col("line_no") > F.col("header_no")).drop("_part")


def _quote_states(c: Column, sep: str) -> Column:
    """What a line does to the quote state, as a struct: whether its end lies
    inside quotes when its start lies outside (``o``) and inside (``i``)."""
    s = _REGEX_SEP[sep]
    open_end = rf'(?:(?:{_quoted(sep)}|(?!{_BLANKS}")[^{s}]*+){s})*+{_BLANKS}"[^"]*+(?:""[^"]*+)*+\z'
    inside = rf'^[^"]*+(?:""[^"]*+)*+(?:\z|"[^{s}]*+{s}{open_end})'
    return F.struct(F.rlike(c, F.lit("^" + open_end)).alias("o"), F.rlike(c, F.lit(inside)).alias("i"))


def quoted_records(lines: DataFrame, usable: DataFrame) -> DataFrame:
    """statement_id, first, last: the runs of lines that are one record, since
    a line break stands inside quotes. ``usable``: statement_id, header_no, sep, parts.

    A line maps the quote state at its start to the one at its end, and maps
    compose. Only lines with a quote can change the state, and of those only
    the ones whose map is not the identity are kept. They are taken in runs of
    RUN_LINES; the state where a run starts is the composition of the maps of
    the runs before it, one row a run. Nothing else of a statement is sorted,
    and no lines are collected. Quotes that are never closed, or only after
    RECORD_SPAN, open no record."""
    def state(end: str) -> Column:
        out = None
        for s in SEPARATORS:
            one = _quote_states(F.col("line"), s)[end]
            out = F.when(F.col("sep") == s, one) if out is None else out.when(F.col("sep") == s, one)
        return out.cast("int")
    quoted = _below(lines.where(F.contains("line", F.lit('"'))), usable, "sep")
    events = evaluate_once(quoted.select("statement_id", "line_no", "line", "sep"), {"o": state("o"), "i": state("i")}) \
        .where("o = 1 OR i = 0").select("statement_id", "line_no", "o", "i", F.expr(f"line_no div {RUN_LINES}").alias("run")) \
        .where("run IS NOT NULL")  # as the join below infers: both its sides are one shuffle then
    # a map is constant (o = i) or swaps (o > i): the state after a line is the last constant plus the swaps since
    swaps = F.when(F.col("o") > F.col("i"), 1).otherwise(0)
    own = Window.partitionBy("statement_id", "run").orderBy("line_no")
    to = own.rowsBetween(Window.unboundedPreceding, 0)
    at = events.withColumn("n", F.sum(swaps).over(to)) \
        .withColumn("c", F.last(F.when(F.col("o") == F.col("i"), F.col("o") + F.col("n")), ignorenulls=True).over(to))
    still_open = F.pmod(F.coalesce("c", F.lit(1)) + F.col("n"), F.lit(2))  # if the run starts inside quotes
    runs = at.groupBy("statement_id", "run").agg(F.max_by(F.struct("n", "c"), "line_no").alias("m"),
                                                 F.min(F.when(still_open == 0, F.col("line_no"))).alias("close"))
    # the same composition over runs: c and n of a run count from its start
    over_runs = Window.partitionBy("statement_id").orderBy("run")
    earlier, later = over_runs.rowsBetween(Window.unboundedPreceding, -1), over_runs.rowsBetween(1, Window.unboundedFollowing)
    runs = runs.withColumn("n", F.coalesce(F.sum("m.n").over(earlier), F.lit(0))) \
        .withColumn("c", F.last(F.col("m.c") + F.col("n"), ignorenulls=True).over(earlier)) \
        .select("statement_id", "run", F.pmod(F.coalesce("c", F.lit(0)) + F.col("n"), F.lit(2)).alias("start"),
                F.first("close", ignorenulls=True).over(later).alias("next_close"))
    placed = at.join(runs, ["statement_id", "run"]).withColumn("open", F.pmod(F.coalesce("c", "start") + F.col("n"), F.lit(2)))
    # a record runs from the line that opens to the next one that closes, in this run or in a later one
    edges = placed.withColumn("was", F.coalesce(F.lag("open").over(own), "start")).where("was <> open") \
        .withColumn("last", F.coalesce(F.lead("line_no").over(own), "next_close"))
    return edges.where((F.col("open") == 1) & (F.col("last") - F.col("line_no") < RECORD_SPAN)) \
        .select("statement_id", F.col("line_no").alias("first"), "last")


def join_quoted_lines(lines: DataFrame, usable: DataFrame) -> DataFrame:
    """Lines of one record (a line break stands inside quotes) as one line,
    under the number of the first.

    Only the buckets of RECORD_SPAN line numbers that such a record touches
    are sorted, each by itself; all other lines pass by without a shuffle. The
    records' ends are checkpointed: three numbers each, which several branches
    read; where there are none, the lines are returned as they are."""
    checkpoint_dir(lines.sparkSession)
    runs = quoted_records(lines, usable).checkpoint()
    if runs.isEmpty():
        return lines.select("statement_id", "line_no", "line")
    bucket = F.expr(f"line_no div {RECORD_SPAN}")
    spread = runs.withColumn("_bucket", F.explode(F.expr(f"sequence(first div {RECORD_SPAN}, last div {RECORD_SPAN})")))  # two at most
    touched = spread.select("statement_id", "_bucket").distinct()
    known = lines.select("statement_id", "line_no", "line", bucket.alias("_bucket"))
    plain = known.join(touched, ["statement_id", "_bucket"], "left_anti").select("statement_id", "line_no", "line")
    marks = spread.select("statement_id", F.greatest("first", F.col("_bucket") * RECORD_SPAN).alias("line_no"),
                          F.lit(None).cast("string").alias("line"), "_bucket", F.struct("first", "last").alias("_r"), F.lit(0).alias("_k"))
    some = known.join(touched, ["statement_id", "_bucket"], "left_semi").select(
        "statement_id", "line_no", "line", "_bucket", F.lit(None).cast("struct<first:bigint,last:bigint>").alias("_r"), F.lit(1).alias("_k"))
    own = Window.partitionBy("statement_id", "_bucket").orderBy("line_no", "_k").rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.unionByName(some).withColumn("_r", F.last("_r", ignorenulls=True).over(own)).where("_k = 1") \
        .withColumn("_record", F.when(F.col("line_no") <= F.col("_r.last"), F.col("_r.first")))
    joined = placed.groupBy("statement_id", F.coalesce("_record", "line_no").alias("line_no")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("line", F.lit("")).alias("line")))), lambda x: x["line"]), "\n").alias("line"))
    return plain.unionByName(joined)


def _not_blank(line: str = "line") -> Column:
    return F.coalesce(ktrim(F.col(line)), F.lit("")) != ""


def header_lines(lines: DataFrame) -> DataFrame:
    """statement_id, header_no, header: each statement's first line that is not
    blank; ``parts``: the ranges of PART_LINES in which it has such lines; and
    ``seps``: the separators that split it into more than one field, each with
    those fields. One aggregation."""
    first = lines.where(_not_blank()).groupBy("statement_id").agg(
        F.min(F.struct("line_no", "line")).alias("_h"), F.collect_set(_part()).alias("parts")) \
        .select("statement_id", F.col("_h.line_no").alias("header_no"), F.col("_h.line").alias("header"), "parts")
    tries = F.array(*[F.struct(F.lit(s).alias("sep"), split_fields(F.col("header"), s).alias("headers")) for s in SEPARATORS])
    return first.withColumn("seps", F.filter(tries, lambda t: F.size(t["headers"]) > 1))


def yields(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """statement_id, sep, detected, kept: for every separator that splits a
    header, whether its columns are recognised and how many of the HEAD_LINES
    lines below the header are then transactions."""
    below = _below(lines.where(_not_blank()), heads, "seps")
    top = Window.partitionBy("statement_id").orderBy("line_no")  # HEAD_LINES a task and statement reach the window
    below = below.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= HEAD_LINES)
    trial = below.withColumn("_t", F.explode("seps"))
    cells = None
    for s in SEPARATORS:
        fields = split_fields(F.col("line"), s)
        cells = F.when(F.col("_t.sep") == s, fields) if cells is None else cells.when(F.col("_t.sep") == s, fields)
    key = F.to_json(F.struct("statement_id", F.col("_t.sep").alias("sep")))
    rows = trial.select(key.alias("statement_id"), F.col("line_no").alias("row_idx"), F.col("_t.headers").alias("headers"), cells.alias("cells"))
    tried = harmonise(rows)
    got = tried.groupBy("statement_id").agg(F.count_if(drop_reason(tried).isNull()).alias("kept"),
                                            F.bool_and(F.col("reject_reason").isNull()).alias("detected"))
    t = F.from_json("statement_id", "statement_id string, sep string")
    return got.select(t["statement_id"].alias("statement_id"), t["sep"].alias("sep"), "detected", "kept")


def sniff_separator(lines: DataFrame) -> DataFrame:
    """Per statement: the number of its header (the first line that is not
    blank), its separator (NULL when none splits the header), its cells and the
    ``parts`` of ``header_lines``.

    Where several separators split the header, the first in order that gives
    transactions below it is taken, else the first whose columns are
    recognised, else the first. Only such statements are read further, and
    only where there are any: the headers are checkpointed to see."""
    checkpoint_dir(lines.sparkSession)
    heads = header_lines(lines).checkpoint()  # a row a statement; read again below and by the caller
    several = heads.where(F.size("seps") > 1)
    chosen = F.get("seps", F.lit(0))
    if not several.isEmpty():
        order = F.array_position(F.array(*map(F.lit, SEPARATORS)), F.col("sep"))
        best = yields(lines, several).groupBy("statement_id").agg(F.min_by("sep", F.struct(
            F.when(F.col("kept") > 0, 0).when(F.col("detected"), 1).otherwise(2), order)).alias("_sep")).checkpoint()
        heads = heads.join(best, "statement_id", "left")
        chosen = F.get(F.filter("seps", lambda t: F.col("_sep").isNull() | (t["sep"] == F.col("_sep"))), F.lit(0))
    return heads.select("statement_id", "header_no", chosen["sep"].alias("sep"), chosen["headers"].alias("headers"), "parts")


def delimited_to_rows(lines: DataFrame) -> DataFrame:
    """Statement text lines -> statement_rows (statement_id, row_idx,
    headers, cells). Blank lines are skipped; statements with no usable
    separator yield nothing here and a row of ``delimited_rejects``."""
    usable = sniff_separator(lines).where(F.col("sep").isNotNull())
    own = lines.select("statement_id", "line_no", "line")
    data = _below(join_quoted_lines(own, usable).where(_not_blank()), usable, "sep", "headers")
    cells = None
    for s in SEPARATORS:
        fields = split_fields(F.col("line"), s)
        cells = F.when(F.col("sep") == s, fields) if cells is None else cells.when(F.col("sep") == s, fields)
    return data.select("statement_id", F.col("line_no").alias("row_idx"), "headers", cells.alias("cells"))


def delimited_rejects(lines: DataFrame) -> DataFrame:
    """Statements that can't be read: statement_id, reason (only blank lines,
    no separator that splits the header, or nothing below it)."""
    blank = lines.groupBy("statement_id").agg(F.count_if(_not_blank()).alias("n"))
    heads = header_lines(lines).select("statement_id", (F.size("seps") > 0).alias("ok"))
    reason = F.when(~F.coalesce("ok", F.lit(False)), "no separator").when(F.col("n") == 1, "no row below the header")
    return blank.join(heads, "statement_id", "left").select("statement_id", reason.alias("reason")).where("reason IS NOT NULL")
