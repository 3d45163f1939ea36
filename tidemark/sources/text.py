"""Raw text ingest: everything as text, with line-level lineage.

Line numbers are exact for files of any size without reading a file in one task and
without moving the lines. Spark numbers rows inside each file split; the rows of all
earlier splits of the same file (one small row per split) give the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.cleaning import empty_as_null
from tidemark.session import cut_lineage

def _cp1252_controls() -> tuple[str, str]:
    """The control characters that windows-1252 uses for punctuation, and what they stand for."""
    pairs = []
    for b in range(0x80, 0xA0):
        try:
            pairs.append((chr(b), bytes([b]).decode("cp1252")))
        except UnicodeDecodeError:
            continue
    return "".join(a for a, _ in pairs), "".join(z for _, z in pairs)


def _blank(c: str) -> Column:
    """A blank cell as ''; the CSV parser reads it as NULL."""
    return F.coalesce(F.col(c), F.lit(""))


# Up to this many file splits (about 64 TB at the default split size) their offsets,
# some 100 bytes each, are sent to every task; beyond it the join is shuffled.
MAX_BROADCAST_SPLITS = 500_000
_MOVED = "file splits changed while lines were numbered; set spark.sql.files.minPartitionNum to keep them fixed"


def _numbered(raw: DataFrame, first_line: int, is_header: Column | None = None) -> DataFrame:
    """Add source_file, file_line and header_line to a file scan (columns straight from the scan).

    A first pass counts the rows of every split; it runs at once. The second pass numbers
    the rows without moving them. Should the splits differ between the passes (a cluster
    that grows changes the default split size), the rows no longer fit their offsets and the
    job stops with a message; a wrong number is never given.
    """
    cols = raw.columns
    scan = raw.select(
        *cols,
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"),
    )
    header_id = F.min(F.when(is_header, F.col("_id"))) if is_header is not None else F.lit(None).cast("bigint")
    counted = scan.groupBy("_path", "_at").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), header_id.alias("_h")
    )
    splits = cut_lineage(counted)
    earlier = Window.partitionBy("_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("*", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    header_line = F.min(F.col("_h") - F.col("_first") + F.col("_before") + first_line)
    offsets = offsets.withColumn("header_line", header_line.over(Window.partitionBy("_path"))).drop("_h")
    if splits.count() <= MAX_BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    inside = F.col("_id") - F.col("_first")
    fits = F.coalesce((inside >= 0) & (inside < F.col("_n")), F.lit(False))

    def checked(c: Column) -> Column:
        return F.when(fits, c).otherwise(F.raise_error(F.lit(_MOVED)).cast("bigint"))

    return scan.join(offsets, ["_path", "_at"], "left").select(
        *cols, "source_file",
        checked(inside + F.col("_before") + first_line).alias("file_line"),
        checked(F.col("header_line")).alias("header_line"),
    )


def _ends_quoted(line: Column, quoted: bool, sep: str) -> Column:
    """Does the line end inside quotes, if it starts inside them or not? A quote opens at the start of a cell alone."""
    OUT, IN, CLOSED = 0, 1, 2
    pieces = F.split(line, '"')
    before = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p, i: F.struct(p.alias("p"), (i == 0).alias("first")))

    def quote(state: Column, x: Column) -> Column:
        opens = F.endswith(x["p"], F.lit(sep)) | ((x["p"] == "") & (x["first"] | (state == CLOSED)))
        return F.when(state == IN, CLOSED).when(opens, IN).otherwise(OUT)

    return F.aggregate(before, F.lit(IN if quoted else OUT), quote) == IN


def _carried(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Add _s0, _s1: is a row's start quoted, if the first row of its key starts outside (0) or inside (1) quotes?

    _e0, _e1 tell how a row ends by how it starts. The last row that ends alike either way fixes the state; the rows
    since then either keep or turn it.
    """
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turned = df.withColumn("_turns", F.sum((F.col("_e0") & ~F.col("_e1")).cast("long")).over(upto))
    fixed = F.when(F.col("_e0") == F.col("_e1"), F.struct(F.col("_e0").alias("ends"), F.col("_turns").alias("turns")))
    turned = turned.withColumns({"_fixed": F.last(fixed, ignorenulls=True).over(before), "_t": F.coalesce(F.last("_turns").over(before), F.lit(0))})

    def start(quoted: bool) -> Column:
        at, since = F.coalesce("_fixed.ends", F.lit(quoted)), F.col("_t") - F.coalesce("_fixed.turns", F.lit(0))
        return at != (since % 2 == 1)

    return turned.withColumns({"_s0": start(False), "_s1": start(True)}).drop("_turns", "_fixed", "_t")


def _records(raw: DataFrame, sep: str = ",", parts: bool = False) -> DataFrame:
    """Lines of a file scan joined to records: value, source_file, file_line (the record's number, from 1), _ahead.

    _ahead: 0, with `parts` the records but the headers of all files before it, in the order of their names.
    The state of the quotes is carried inside each file split for either start, then from split to split (one small row
    each), so no file is read in one task. Only a record of several lines is put together from its lines.
    """
    lines = raw.select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"),
    )
    lines = lines.withColumns({"_e0": _ends_quoted(F.col("value"), False, sep), "_e1": _ends_quoted(F.col("value"), True, sep), "_some": F.trim(F.translate("value", "\r", "")) != ""})

    def counted(df: DataFrame) -> DataFrame:
        upto = Window.partitionBy("_path", "_at").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
        starts = [F.sum((~F.col(f"_s{k}") & F.col("_some")).cast("long")).over(upto).alias(f"_n{k}") for k in (0, 1)]
        return _carried(df, ["_path", "_at"], "_id").select("*", *starts, F.row_number().over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias("_row"))

    # The first pass runs at once, over lines without their text.
    last = lambda k: F.max_by(F.when(F.col(f"_s{k}"), F.col("_e1")).otherwise(F.col("_e0")), "_id").alias(f"_e{k}")
    splits = cut_lineage(counted(lines.drop("value")).groupBy("_path", "_at").agg(last(0), last(1), F.max("_n0").alias("_n0"), F.max("_n1").alias("_n1"), F.count(F.lit(1)).alias("_rows")))
    earlier = Window.partitionBy("_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("_s0"), F.col("_n1")).otherwise(F.col("_n0"))
    ends_open = F.when(F.col("_s0"), F.col("_e1")).otherwise(F.col("_e0"))
    offsets = _carried(splits, ["_path"], "_at").select("_path", "_at", F.col("_s0").alias("_quoted"), F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias("_before"), "_rows", own.alias("_own"), ends_open.alias("_ends_open"))
    # A quote that is never closed would take the rest of its file into one cell.
    at_end = offsets.groupBy("_path").agg(F.max_by("_ends_open", "_at").alias("open"), F.max_by(F.col("_before") + F.col("_own"), "_at").alias("line"))
    unclosed = at_end.where("open").orderBy("_path").limit(5).collect()
    if unclosed:
        raise ValueError("a quote is never closed: " + "; ".join(f"record {r.line} of {r._path}" for r in unclosed))
    offsets = offsets.drop("_own", "_ends_open").withColumn("_ahead", F.lit(0).cast("bigint"))
    if parts:  # One row a file. The numbers in the names of parts grow longer at last.
        names = Window.orderBy(F.length("_path"), "_path").rowsBetween(Window.unboundedPreceding, -1)
        ahead = at_end.select("_path", F.coalesce(F.sum(F.greatest(F.col("line") - 1, F.lit(0))).over(names), F.lit(0)).alias("_ahead"))
        offsets = offsets.drop("_ahead").join(ahead, "_path")
    told = counted(lines).join(offsets, ["_path", "_at"], "left")
    fits = F.coalesce(F.col("_row") <= F.col("_rows"), F.lit(False))
    number = F.col("_before") + F.when(F.col("_quoted"), F.col("_n1")).otherwise(F.col("_n0"))
    inside = F.when(F.col("_quoted"), F.col("_s1")).otherwise(F.col("_s0"))
    ends = F.when(inside, F.col("_e1")).otherwise(F.col("_e0"))
    told = told.select(
        "_path", "source_file", "_ahead", "_at", "_row", "value", "_some", inside.alias("_in"), ends.alias("_open"),
        F.when(fits, number).otherwise(F.raise_error(F.lit(_MOVED)).cast("bigint")).alias("file_line"),
    )
    whole = told.where(~F.col("_in") & ~F.col("_open") & F.col("_some")).select("value", "source_file", "file_line", "_ahead")
    pieces = told.where(F.col("_in") | F.col("_open")).groupBy("_path", "source_file", "file_line", "_ahead").agg(F.sort_array(F.collect_list(F.struct("_at", "_row", "value"))).alias("_parts"))
    return whole.unionByName(pieces.select(F.array_join(F.transform("_parts", lambda p: p["value"]), "\n").alias("value"), "source_file", "file_line", "_ahead"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one or many files: value, source_file, file_line (from 1)."""
    return _numbered(spark.read.text(path), 1).drop("header_line")


def read_raw_text(
    spark: SparkSession, path: str, columns: Sequence[str], skip: int, source_id: str, sep: str = ","
) -> DataFrame:
    """Delimited files with ``skip`` preamble lines and a header line, all columns as text.

    Blanks stay ''. Only files whose header line (right after the preamble) is exactly
    ``columns`` are read; quotes and spaces in the header do not matter.
    """
    def bare(text: Column) -> Column:
        return F.translate(text, '" ', "")

    lines = _numbered(spark.read.text(path), 1, bare(F.col("value")) == bare(F.lit(sep.join(columns))))
    schema = ", ".join(f"`{c}` string" for c in columns)
    cells = F.from_csv("value", schema, {"sep": sep})
    return (
        lines.where((F.col("header_line") == skip + 1) & (F.col("file_line") > skip + 1) & (F.trim("value") != ""))
        .select("source_file", "file_line", cells.alias("_c"))
        .select("source_file", "file_line", *[_blank(f"_c.`{c}`").alias(c) for c in columns], F.lit(source_id).alias("source_id"))
    )


def read_raw_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    source_id: str,
    encoding: str = "UTF-8",
    empty_to_null: bool = False,
    parts: bool = False,
) -> DataFrame:
    """CSV with a header in any encoding, all columns as text; blanks kept or turned into NULL.

    Cells may be quoted, with line breaks and doubled quotes inside; lines end with \\n or \\r\\n. file_line
    counts records from 2, the record after the header; blank lines are none. With `parts` the files are parts of one in the order
    of their names, each with the header, and file_line runs on from part to part. Spark reads no windows-1252; it equals
    ISO-8859-1 but for the control range, which is translated.
    """
    cp1252 = encoding.lower() in ("windows-1252", "cp1252")
    coded = "ISO-8859-1" if cp1252 else encoding
    raw = spark.read.option("lineSep", "\n").option("encoding", coded).text(path)
    if coded.lower() not in ("utf-8", "utf8"):
        raw = raw.withColumn("value", F.decode(F.col("value").cast("binary"), coded))
    schema = ", ".join(f"`{c}` string" for c in columns)
    record = F.regexp_replace("value", r"\r\z", "")
    cells = F.from_csv(record, schema, {"escape": '"', "multiLine": "true", "lineSep": "\n"})
    out = _records(raw, parts=parts).where("file_line > 1").select("source_file", (F.col("file_line") + F.col("_ahead")).alias("file_line"), cells.alias("_c"))
    out = out.select("source_file", "file_line", *[F.col(f"_c.`{c}`").alias(c) for c in columns])
    if cp1252:
        src, dst = _cp1252_controls()
        out = out.select(*[F.translate(F.col(f"`{c}`"), src, dst).alias(c) for c in columns], "source_file", "file_line")
    cell = (lambda c: empty_as_null(F.col(c))) if empty_to_null else _blank
    out = out.select(*[cell(f"`{c}`").alias(c) for c in columns], "source_file", "file_line")
    return out.withColumn("source_id", F.lit(source_id))


def read_typed_csv(spark: SparkSession, path: str, schema: str, null_value: str | None = None) -> DataFrame:
    """CSV with a header and declared types, as this library writes it: quoted cells with line breaks and doubled quotes.

    Records are put together over file splits (see ``read_raw_csv``), so a large file is not read in one task. Blank cells are NULL, words such
    as NA are text. A cell that does not fit its type is NULL.
    """
    lines = _records(spark.read.option("lineSep", "\n").text(path)).where("file_line > 1")
    options = {"escape": '"', "multiLine": "true", "lineSep": "\n", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if null_value is not None:
        options["nullValue"] = null_value
    return lines.select(F.from_csv(F.regexp_replace("value", r"\r\z", ""), schema, options).alias("_c")).select("_c.*")


def pick_longest_file(df: DataFrame, has_header: Column, file_col: str = "source_file") -> tuple[DataFrame, DataFrame]:
    """Rows of the longest file among those that qualify, and a report of the others.

    Among files of equal length the first by name is used.
    """
    counts = df.groupBy(file_col).agg(F.count(F.lit(1)).alias("n"), F.bool_and(has_header).alias("ok"))
    best = counts.where("ok").agg(F.min_by(file_col, F.struct(-F.col("n"), F.col(file_col))).alias("f")).scalar()
    report = counts.withColumn("_best", best).select(
        file_col, "n", F.when(F.col(file_col) == F.col("_best"), "used").when(F.col("ok"), "ignored").otherwise("other header").alias("state")
    )
    used = df.withColumn("_best", best).where(F.col(file_col) == F.col("_best")).drop("_best")
    return used, report


def profile_ingest(df: DataFrame, value: str, date: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, blank values ('' or '.'), first and last date as loaded."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.trim(value).isin("", ".")).alias("blanks"),
        F.min(date).alias("first"), F.max(date).alias("last"),
    )
