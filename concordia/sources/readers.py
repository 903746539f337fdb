"""Readers: files of all kinds, the evidence log, packs and catalogs, and frames of other libraries."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.operators.evidence import SCHEMA

NULLS = ("", "null", "NULL")


def read_csv(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """All columns as strings, quotes respected; ``clean`` trims, makes null spellings null and drops empty rows."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)
    if clean:
        df = df.select(*(F.when(~F.trim(f"`{c}`").isin(*NULLS), F.trim(f"`{c}`")).alias(c) for c in df.columns)).dropna(how="all")
    return df


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An array of objects, one object, or one object a line."""
    return spark.read.option("multiLine", not lines).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def list_files(spark: SparkSession, path: str, kinds: Iterable[str] = ("csv", "json", "parquet")) -> DataFrame:
    """path, length, modified of the files of some kinds below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(kinds)}}}").load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """The evidence log: JSON lines; malformed lines are dropped."""
    return _flat(spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path))


def stream_evidence(spark: SparkSession, path: str) -> DataFrame:
    """The same as an unbounded table over new files."""
    return _flat(spark.readStream.schema(EVENT).option("mode", "DROPMALFORMED").json(path))


#: An event as it is written.
EVENT = (
    "id string, timestamp timestamp, type string, source string, data struct<anchor_id:string,column_name:string,dataset:string,"
    "confidence_score:double,details:map<string,string>>, metadata map<string,string>"
)


def _flat(df: DataFrame) -> DataFrame:
    names = [p.split()[0] for p in SCHEMA.split(", ")]
    return df.select(*(F.col(n) if n in df.columns else F.col(f"data.{n}").alias(n) for n in names)).where(F.col("id").isNotNull())


def read_yaml(path: str) -> list[dict]:
    """The documents of a small YAML file (packs, anchors, unit catalogs)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return [d for d in yaml.safe_load_all(f) if d]


def read_fx(spark: SparkSession, path: str) -> DataFrame:
    """Exchange rates as a table: from_ccy, to_ccy, rate, ts."""
    return spark.read.schema("from_ccy string, to_ccy string, rate double, ts timestamp").option("header", True).csv(path)


def read_warehouse(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query run by a database over JDBC; give partitionColumn and bounds to read in parallel."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


# --- frames of other libraries ----------------------------------------------


@functools.singledispatch
def to_spark(data: object, spark: SparkSession) -> DataFrame:
    """A DataFrame of whatever ``data`` is; further kinds by to_spark.register()."""
    if hasattr(data, "to_arrow"):
        return spark.createDataFrame(data.to_arrow())
    if hasattr(data, "fetch_arrow_table"):
        return spark.createDataFrame(data.fetch_arrow_table())
    if hasattr(data, "to_pandas"):
        return spark.createDataFrame(data.to_pandas())
    if type(data).__module__.startswith(("pandas", "pyarrow")):
        return spark.createDataFrame(data)
    raise TypeError(f"no adapter for {type(data).__name__}")


@to_spark.register
def _(data: DataFrame, spark: SparkSession) -> DataFrame:
    return data


@to_spark.register
def _(data: dict, spark: SparkSession) -> DataFrame:
    """Columns by name; or columns and rows of a query result."""
    if set(data) == {"columns", "data"} and all(isinstance(r, (list, tuple)) for r in data["data"]):
        return spark.createDataFrame([tuple(r) for r in data["data"]], list(data["columns"]))
    return spark.createDataFrame(list(zip(*data.values(), strict=True)), list(data))


@to_spark.register
def _(data: list, spark: SparkSession) -> DataFrame:
    """Objects; the columns are the sorted union of their keys."""
    names = sorted({k for row in data if isinstance(row, Mapping) for k in row})
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in data], names)


def supported() -> list[str]:
    return sorted(t.__name__ for t in to_spark.registry if t is not object) + ["Arrow-convertible", "pandas", "pyarrow"]


def diff_columns(spark: SparkSession, path: str) -> DataFrame:
    """file, change ('added' or 'removed'), column, type: columns in DDL or ORM lines of unified diffs."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "(?m)^diff --git ")).alias("part"))
    rows = rows.select(F.regexp_extract("part", r"(?m)^\+\+\+ b/(\S+)", 1).alias("file"), F.explode(F.split("part", "\n")).alias("line")).where("file <> ''")
    body = F.regexp_replace("line", r"^[+-]\s*", "")
    ddl, orm = r"(?i)^(?:add\s+column\s+)?([a-z_]\w*)\s+((?:var)?char|text|int(?:eger)?|bigint|numeric|decimal|float|double|bool(?:ean)?|date|timestamp|uuid|jsonb?)\b", r"^([A-Za-z_]\w*)\s*=\s*(?:db\.)?Column\(\s*(?:db\.)?(\w+)"
    both = F.coalesce(*(F.when(F.regexp_extract(body, p, 1) != "", F.struct(F.regexp_extract(body, p, 1).alias("column"), F.lower(F.regexp_extract(body, p, 2)).alias("type"))) for p in (orm, ddl)))
    change = F.when(F.col("line").rlike(r"^\+(?!\+\+)"), "added").when(F.col("line").rlike("^-(?!--)"), "removed")
    return rows.select("file", change.alias("change"), both.alias("c")).where("change is not null and c is not null").select("file", "change", "c.column", "c.type")
