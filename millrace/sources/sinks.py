"""Table sinks: append, replacement of touched partitions, keyed inserts and upserts, copies, small extracts.

Tables that change by key or together are those of a commits.Store. A versioned table is a folder of complete copies,
`version=<n>`. A copy counts once its _SUCCESS file is there, so a write that fails or is repeated leaves the table as
it was; readers take the newest copy that counts.
"""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.sources.commits import Store, put_file

VERSION = "version="


def append(df: DataFrame, path: str, by: list[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, column: str, values: list[str]) -> None:
    """Rewrites the partitions `values` and no other. One that is asked for but has no rows is deleted: dynamic
    overwrite alone would leave its old files."""
    spark = df.sparkSession
    df.filter(df[column].isin(values)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    present = {str(r[0]) for r in df.select(column).filter(df[column].isin(values)).distinct().collect()}  # at most the values asked for
    jvm = spark._jvm
    for value in sorted({str(v) for v in values} - present):
        old = jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
        fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(old):
            fs.delete(old, True)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _folder(spark, path)
    return fs.exists(at)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def insert_absent(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose key the table does not have."""
    known = read_or_empty(df.sparkSession, path, df.schema).select(*keys)
    append(df.join(known, keys, "left_anti").select(*df.columns), path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the copies that count, in order."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    return sorted(int(x.removeprefix(VERSION)) for x in names if x.startswith(VERSION) and exists(spark, f"{path}/{x}/_SUCCESS"))


def read_version(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The newest copy, or no rows."""
    found = versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{VERSION}{found[-1]}") if found else spark.createDataFrame([], schema)


def write_version(df: DataFrame, path: str, number: int | None = None, keep: int = 2) -> None:
    """Writes df as the next copy, or as copy `number`; all but the newest `keep` go. df may read the newest copy."""
    spark = df.sparkSession
    found = versions(spark, path)
    number = (found[-1] + 1 if found else 0) if number is None else number
    df.write.mode("overwrite").parquet(f"{path}/{VERSION}{number}")
    for old in versions(spark, path)[:-keep]:
        at, fs = _folder(spark, f"{path}/{VERSION}{old}")
        fs.delete(at, True)


#: The one table of a store that upsert_into fills.
ROWS = "rows"


def upsert_into(path: str, source: DataFrame, keys: list[str]) -> None:
    """Rows of source in place of those with their keys; writes those rows, and now and then the table (commits.MERGE_AT)."""
    with Store(source.sparkSession, path).transaction() as t:
        t.upsert(ROWS, source, keys)


def read_upserted(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """What upsert_into has stored."""
    return Store(spark, path).read(ROWS, schema)


def extract(df: DataFrame, path: str, order: list[str], kind: str = "json", rows: int = 100_000) -> None:
    """A small aggregate as one JSON or CSV file for other programs: written beside its place and then renamed.

    More than `rows` rows are refused; nothing is cut.
    """
    spark = df.sparkSession
    if kind not in ("json", "csv"):
        raise ValueError(f"an extract is json or csv, not {kind}")
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"an extract has at most {rows} rows")
    found = [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]
    text = io.StringIO(newline="")
    if kind == "json":
        json.dump(found, text, default=str, ensure_ascii=False)
    else:
        writer = csv.DictWriter(text, df.columns, lineterminator="\n")
        writer.writeheader()
        writer.writerows(found)
    put_file(spark, path, text.getvalue(), overwrite=True)


def save_tables(tables: dict[str, DataFrame], database: str) -> None:
    """Frames as named tables of the catalog; each replaces its former rows."""
    for spark in {id(df.sparkSession): df.sparkSession for df in tables.values()}.values():
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in tables.items():
        df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(f"{database}.{name}")


def replace_children(parents: DataFrame, children: dict[str, DataFrame], key: str, root: str) -> None:
    """Parents and their child tables: rows of the keys in `parents` are replaced in every table, others stay.

    A child table without rows for a key loses the key's old rows. All tables change at once (see commits.Store), and
    only the new rows are written.
    """
    keys = parents.select(key).distinct()
    with Store(parents.sparkSession, root).transaction() as t:
        for name, df in {"parents": parents, **children}.items():
            t.upsert(name, df.join(keys, key, "left_semi").select(*df.columns), [key], keys)


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows, and target rows whose key the source does not have."""
    return source.unionByName(target.join(source.select(*keys), keys, "left_anti"))
