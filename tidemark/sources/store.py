"""Typed tables in and out: collected tables, results, exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.governance import assert_no_columns, trim_restricted
from tidemark.sources.text import read_typed_csv


# Cells with line breaks, quotes and outer spaces come back as they were written.
_QUOTED = {"header": True, "escape": '"'}
_WRITE = {**_QUOTED, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_collected(spark: SparkSession, folder: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """Hand-collected tables, one CSV each, with their declared types."""
    return {name: read_typed_csv(spark, f"{folder}/{name}.csv", s) for name, s in schemas.items()}


def read_baseline(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A frozen profile: only an empty cell is NULL; words such as 'NA' or 'null' are text."""
    return read_typed_csv(spark, path, schema, null_value="")


def available(spark: SparkSession, tables: Mapping[str, str | None]) -> set[str]:
    """Which tables there are, before any of them is read: name, and also ``<name>_data`` if it has rows.

    tables: name -> parquet path, or None for a table of the catalog. A missing path or table is not an error; anything else that goes
    wrong is. Whether there are rows is told by the first one found.
    """
    found = set()
    for name, path in tables.items():
        if path is None:
            if not spark.catalog.tableExists(name):
                continue
            table = spark.table(name)
        else:
            try:
                table = spark.read.parquet(path)
            except AnalysisException as e:
                # A folder without any file is there, but has no schema to be read by.
                if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
                continue
        found.add(name)
        if not table.isEmpty():
            found.add(f"{name}_data")
    return found


def require_tables(present: Collection[str], needed: Sequence[str]) -> None:
    """Stop before any job if an input is missing, naming all that are."""
    missing = sorted(set(needed) - set(present))
    if missing:
        raise FileNotFoundError(f"missing raw tables: {', '.join(missing)}")


def stub(spark: SparkSession, schema: str) -> DataFrame:
    """Empty typed stand-in for an optional input, so everything downstream still builds."""
    return spark.createDataFrame([], schema)


def _path(spark: SparkSession, path: str):
    """(file system, path) of a folder, whatever store it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _rebuilt(spark: SparkSession, folder: str, write: Callable[[str], None]) -> None:
    """A folder as ``write`` makes it: written beside the old one, which is replaced only when all is there."""
    folder = folder.rstrip("/")
    fresh, old = f"{folder}-new-{uuid.uuid4().hex}", f"{folder}-old-{uuid.uuid4().hex}"
    store, target = _path(spark, folder)
    try:
        write(fresh)
    except BaseException:
        store.delete(_path(spark, fresh)[1], True)
        raise
    if store.exists(target) and not store.rename(target, _path(spark, old)[1]):
        raise OSError(f"{folder} could not be set aside")
    if not store.rename(_path(spark, fresh)[1], target):
        store.rename(_path(spark, old)[1], target)
        raise OSError(f"{fresh} could not take the place of {folder}")
    store.delete(_path(spark, old)[1], True)


def save_tables(tables: Mapping[str, DataFrame], folder: str, partition_by: Mapping[str, Sequence[str]] | None = None) -> None:
    """Full rebuild: the folder holds exactly these tables afterwards, as parquet, optionally partitioned for pruning.

    All tables are written to a folder of their own first and then take the old one's place, so a build that fails leaves the old tables
    as they were, and tables may be computed from those they replace.
    """
    def write(fresh: str) -> None:
        for name, df in tables.items():
            keys = (partition_by or {}).get(name)
            (df.write.partitionBy(*keys) if keys else df.write).parquet(f"{fresh}/{name}")

    if tables:
        _rebuilt(next(iter(tables.values())).sparkSession, folder, write)


def load_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def export_csv(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Every table and view as CSV with a header."""
    for name, df in tables.items():
        df.write.mode("overwrite").options(**_WRITE).csv(f"{folder}/{name}")


def save_result(df: DataFrame, name: str, folder: str, deny: Sequence[str] = ()) -> dict[str, int]:
    """A result as CSV master copy and as table; returns its shape.

    The result is computed once: the CSV and the count come from the written table.
    """
    assert_no_columns(df, deny, name)
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/table/{name}")
    saved = spark.read.schema(df.schema).parquet(f"{folder}/table/{name}")
    export_csv({name: saved}, f"{folder}/csv")
    return {"rows": saved.count(), "columns": len(df.columns)}


def load_results(spark: SparkSession, folder: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """Results of an earlier run, from their CSV master copies. A copy that has lost or gained rows against its table,
    where there is one, stops the job."""
    out = {n: read_typed_csv(spark, f"{folder}/csv/{n}", s) for n, s in schemas.items()}
    for name, copy in out.items():
        try:
            saved = spark.read.parquet(f"{folder}/table/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        rows, want = copy.count(), saved.count()
        if rows != want:
            raise ValueError(f"{name}: {rows} rows in the master copy, {want} in the table")
    return out


def json_cell(c: Column) -> Column:
    """Text cell as a JSON value: '' null, whole numbers, numbers with 6 decimals, else text.

    A number with leading zeros is a code and stays text.
    """
    is_int = c.rlike(r"\A-?\d+\z") & ~c.rlike(r"\A-?0\d")
    is_float = c.rlike(r"\A-?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?\z")
    x = F.round(c.try_cast("double"), 6)
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    number = F.when(whole, x.try_cast("bigint").cast("string")).otherwise(x.cast("string"))
    quoted = F.to_json(F.array(c))
    text = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    plain = is_int & (F.length(c) < 19)
    return (
        F.when(c.isNull() | (c == ""), "null").when(plain, c.try_cast("bigint").cast("string")).when(is_int, c)
        .when(is_float & ~c.rlike(r"\A-?\d+\z"), number).otherwise(text)
    )


def dataset_rows(df: DataFrame, page: str, dataset: str, drop_cols: Sequence[str] = (), drop_rows: Column | None = None, deny: Sequence[str] = ()) -> DataFrame:
    """A dataset as rows of JSON arrays: page, dataset, row. Restricted columns and rows are left out."""
    out = trim_restricted(assert_no_columns(df, deny, dataset), drop_cols, drop_rows)
    cells = [json_cell(F.col(c).cast("string")) for c in out.columns]
    row = F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]"))
    return out.select(F.lit(page).alias("page"), F.lit(dataset).alias("dataset"), row.alias("row"))


def export_datasets(datasets: Sequence[tuple[str, str, DataFrame]], folder: str, drop_cols: Mapping[str, Sequence[str]] | None = None,
                    drop_rows: Mapping[str, Column] | None = None, deny: Sequence[str] = ()) -> None:
    """All datasets of all pages as one bundle: a folder per page and dataset, replaced as a whole when all are written."""
    rows = [dataset_rows(df, page, name, (drop_cols or {}).get(name, ()), (drop_rows or {}).get(name), deny) for page, name, df in datasets]
    if rows:
        bundle = reduce(lambda a, b: a.unionByName(b), rows)
        _rebuilt(bundle.sparkSession, folder, lambda fresh: bundle.write.partitionBy("page", "dataset").text(fresh))


def read_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """A bundle as page, dataset, row; only the folders asked for are read."""
    return spark.read.schema("value string, page string, dataset string").text(folder).select("page", "dataset", F.col("value").alias("row"))
