"""Several Parquet tables below one root that change together.

A commit is one small file, `_commits/<number>.json`, that names the folders of every table. Data is written to new
folders first; the commit file is then put in its place by a rename that does not overwrite. So a reader sees all of a
transaction or nothing, and of two writers with one number one has to go on from the other's commit. (The rename has to
be atomic, as it is on HDFS and local disks.)

A table has entries (folders of rows, with a tag if they are a part that can be replaced) and deltas. A delta holds the
keys that it touches and their new rows; a row counts if no later delta touches its key. An upsert writes its own rows
alone; when deltas hold more than MERGE_AT of the table's rows, or are many, the table is written anew. Rows with a
null key are never replaced.

Schemas grow: a commit may add columns and widen types; files keep the schema that they were written with and are read
as the newest one. Narrower and unlike types are refused.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.tables import bounded

MERGE_AT, MOST_DELTAS = 0.1, 20
#: Commits that stay readable; folders that only older ones name are deleted.
KEEP = 5
TRIES = 50
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_PART = "__part"

State = dict
Change = Callable[[State], State]


class Conflict(RuntimeError):
    """What a change was made from is no longer there."""


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def put_file(spark: SparkSession, path: str, text: str, overwrite: bool) -> bool:
    """Writes a small file beside its place and renames it; False if it may not overwrite one that is there."""
    at, fs = file_system(spark, path)
    beside, _ = file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, kind = spark._jvm, getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, int(overwrite))
    if overwrite:
        options[0] = kind.OVERWRITE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(at), options)
        return True
    except Py4JJavaError as error:
        fs.delete(beside, False)
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise


def wider(old: T.DataType, new: T.DataType) -> T.DataType:
    """The type of a column that had `old` and gets `new`: equal, or wider."""
    kinds = (type(old), type(new))
    fits = old == new
    if not fits and isinstance(old, _NUMBERS) and isinstance(new, _NUMBERS):
        fits = _NUMBERS.index(kinds[1]) > _NUMBERS.index(kinds[0])
    elif not fits and isinstance(new, T.DoubleType):
        fits = isinstance(old, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType))
    elif not fits and kinds == (T.DecimalType, T.DecimalType):
        fits = new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    if not fits:
        raise ValueError(f"{old.simpleString()} can't become {new.simpleString()}")
    return new


def grown(old: T.StructType, new: T.StructType) -> T.StructType:
    """old with the wider types and the further columns of new; what new lacks will be null in its rows."""
    types = {f.name: f.dataType for f in new}
    out = []
    for f in old:
        try:
            out.append(T.StructField(f.name, wider(f.dataType, types[f.name]) if f.name in types else f.dataType))
        except ValueError as error:
            raise ValueError(f"{f.name}: {error}") from None
    return T.StructType([*out, *[T.StructField(f.name, f.dataType) for f in new if f.name not in old.names]])


def _plain(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


class Store:
    """The tables below a root."""

    def __init__(self, spark: SparkSession, root: str, keep: int = KEEP):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _commit_path(self, number: int) -> str:
        return f"{self.root}/_commits/{number:012}.json"

    def commits(self) -> list[int]:
        at, fs = file_system(self.spark, f"{self.root}/_commits")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(x.removesuffix(".json")) for x in names if x.endswith(".json") and x.removesuffix(".json").isdigit())

    def state(self, number: int | None = None) -> tuple[int, dict[str, State]]:
        """(number, tables) of a commit, the newest by default; -1 and nothing before the first."""
        found = self.commits()
        number = (found[-1] if found else -1) if number is None else number
        if number < 0:
            return -1, {}
        at, fs = file_system(self.spark, self._commit_path(number))
        stream = fs.open(at)
        try:
            return number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Everything that is changed inside counts at once at the end, or not at all if something fails."""
        t = Transaction(self)
        yield t
        t.commit()

    def read(self, name: str, schema: T.StructType | str | None = None, number: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """A table as of a commit; of a table that is not there, no rows of `schema`. parts: entries of these tags alone."""
        return self._frame(self.state(number)[1].get(name), schema, parts)

    def _frame(self, table: State | None, schema: T.StructType | str | None, parts: list[str] | None) -> DataFrame:
        if table is None:
            if schema is None:
                raise ValueError("there is no such table yet")
            return self.spark.createDataFrame([], schema)
        newest = T.StructType.fromJson(table["schema"])
        entries = [e for e in table["entries"] if parts is None or e["tag"] in parts]
        base = self._union([self._files([f"{self.root}/{e['folder']}" for e in entries if e["schema"] == v], table, v) for v in sorted({e["schema"] for e in entries})], newest)
        if table["deltas"]:
            keys = table["keys"]
            read = lambda d, kind: (f"{self.root}/{d['folder']}/{kind}", d)
            key_type = T.StructType([f for f in newest if f.name in keys])
            touched = [self.spark.read.schema(T.StructType.fromJson(d["key_schema"])).parquet(read(d, "keys")[0]).select(*[F.col(f.name).cast(f.dataType) for f in key_type]).withColumn("__last", F.lit(n)) for n, d in enumerate(table["deltas"])]
            last = reduce(DataFrame.unionByName, touched).groupBy(*keys).agg(F.max("__last").alias("__last"))
            last = bounded(last)
            rows = [self._files([read(d, "rows")[0]], table, d["schema"]).withColumn("__n", F.lit(n)) for n, d in enumerate(table["deltas"])]
            new = reduce(DataFrame.unionByName, rows).join(last, keys, "left").filter("__last is null or __last = __n")
            base = base.join(last, keys, "left_anti").select(*newest.names).unionByName(new.select(*newest.names))
        return base

    def _files(self, paths: list[str], table: State, version: int) -> DataFrame:
        """Files of one schema, as the newest."""
        own, newest = T.StructType.fromJson(table["schemas"][version]), T.StructType.fromJson(table["schema"])
        df = self.spark.read.schema(own).parquet(*paths)
        return df.select(*[(F.col(f"`{f.name}`") if f.name in own.names else F.lit(None)).cast(f.dataType).alias(f.name) for f in newest])

    def _union(self, frames: list[DataFrame], schema: T.StructType) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def rows(self, folder: str) -> int:
        """Number of rows of a folder, from the files' footers."""
        return self.spark.read.parquet(f"{self.root}/{folder}").count()

    def merge(self, name: str, make: Callable[[DataFrame], DataFrame] | None = None, notes: Callable[[State], dict] | None = None) -> bool:
        """Writes what a table has now as one entry without deltas, or what `make` makes of it; what others add in the
        meantime stays as it is. False if others have replaced what was read: then nothing is changed."""
        table = self.state()[1][name]
        t, rows = Transaction(self), self._frame(table, None, None)
        entry = t.entry(name, make(rows) if make else rows)
        more = notes(table) if notes else {}

        def change(now: State) -> State:
            n = len(table["deltas"])
            if any(e not in now["entries"] for e in table["entries"]) or now["deltas"][:n] != table["deltas"]:
                raise Conflict(name)
            rest = [e for e in now["entries"] if e not in table["entries"]]
            return {**t.grow(now, entry), "entries": [t.place(now, entry, None), *rest], "deltas": now["deltas"][n:], "rows": entry["rows"] + now["rows"] - table["rows"], "delta_rows": now["delta_rows"] - table["delta_rows"], "notes": now["notes"] | more}

        t.changes.append((name, change))
        try:
            t.commit(merge=False)
        except Conflict:
            return False
        return True

    def clean(self, newest: int) -> None:
        """Deletes commits beyond the last `keep` and what only they name."""
        found = self.commits()
        old = [n for n in found if n <= newest - self.keep]
        if not old:
            return
        kept = set().union(*[_folders(self.state(n)[1]) for n in found if n not in old])
        for n in old:
            for folder in _folders(self.state(n)[1]) - kept:
                at, fs = file_system(self.spark, f"{self.root}/{folder}")
                fs.delete(at, True)
            at, fs = file_system(self.spark, self._commit_path(n))
            fs.delete(at, False)


def _folders(tables: dict[str, State]) -> set[str]:
    return {e["folder"] for t in tables.values() for e in [*t["entries"], *t["deltas"]]}


class Transaction:
    """Changes of tables of one store; each is a function from the table's newest state, so others' commits are built on."""

    def __init__(self, store: Store):
        self.store, self.changes = store, []

    def _new_folder(self, name: str) -> str:
        return f"{name}/{uuid.uuid4().hex}"

    def _ready(self, name: str, df: DataFrame) -> None:
        """Refuses a schema before anything is written."""
        if (table := self.store.state()[1].get(name)) is not None:
            grown(T.StructType.fromJson(table["schema"]), _plain(df.schema))

    def entry(self, name: str, df: DataFrame) -> State:
        self._ready(name, df)
        folder = self._new_folder(name)
        df.write.parquet(f"{self.store.root}/{folder}")
        return {"folder": folder, "file_schema": _plain(df.schema).jsonValue(), "rows": self.store.rows(folder)}

    @staticmethod
    def grow(table: State, entry: State) -> State:
        schema = T.StructType.fromJson(entry["file_schema"])
        newest = grown(T.StructType.fromJson(table["schema"]), schema) if table["schema"] else schema
        schemas = table["schemas"] if entry["file_schema"] in table["schemas"] else [*table["schemas"], entry["file_schema"]]
        return {**table, "schema": newest.jsonValue(), "schemas": schemas}

    def place(self, table: State, entry: State, tag: str | None) -> State:
        return {"folder": entry["folder"], "tag": tag, "schema": self.grow(table, entry)["schemas"].index(entry["file_schema"])}

    def append(self, name: str, df: DataFrame, tag: str | None = None) -> None:
        e = self.entry(name, df)

        def change(t: State) -> State:
            if t["deltas"]:
                raise ValueError(f"{name} has keys: rows come by upsert")
            return {**self.grow(t, e), "entries": [*t["entries"], self.place(t, e, tag)], "rows": t["rows"] + e["rows"]}

        self.changes.append((name, change))

    def replace(self, name: str, df: DataFrame) -> None:
        e = self.entry(name, df)
        self.changes.append((name, lambda t: {**self.grow(t, e), "entries": [self.place(t, e, None)], "deltas": [], "rows": e["rows"], "delta_rows": 0}))

    def replace_parts(self, name: str, df: DataFrame, column: str, values: list[str]) -> None:
        """The parts `values` of a table: rows whose column has that value. A part without rows goes; others stay."""
        self._ready(name, df)
        folder = self._new_folder(name)
        wanted = df.filter(F.col(column).cast("string").isin(values))
        wanted.withColumn(_PART, F.col(column).cast("string")).write.partitionBy(_PART).parquet(f"{self.store.root}/{folder}")
        at, fs = file_system(self.store.spark, f"{self.store.root}/{folder}")
        there = sorted(x.getPath().getName().removeprefix(f"{_PART}=") for x in fs.listStatus(at) if x.isDirectory())
        e = {"file_schema": _plain(df.schema).jsonValue()}
        made = {v: {"folder": f"{folder}/{_PART}={v}", **e} for v in there}

        def change(t: State) -> State:
            rest = [x for x in t["entries"] if x["tag"] not in values]
            return {**self.grow(t, e), "entries": [*rest, *[self.place(t, made[v], v) for v in there]]}

        self.changes.append((name, change))

    def upsert(self, name: str, df: DataFrame, keys: list[str], touched: DataFrame | None = None) -> None:
        """Rows of df in place of those with their keys; keys in `touched` (by default those of df) that have no row in df go."""
        self._ready(name, df)
        folder = self._new_folder(name)
        df.write.parquet(f"{self.store.root}/{folder}/rows")
        own = (touched if touched is not None else self.store.spark.read.schema(df.schema).parquet(f"{self.store.root}/{folder}/rows")).select(*keys).distinct()
        own.write.parquet(f"{self.store.root}/{folder}/keys")
        e = {"file_schema": _plain(df.schema).jsonValue()}
        n = self.store.rows(f"{folder}/rows") + self.store.rows(f"{folder}/keys")

        def change(t: State) -> State:
            if t["keys"] not in ([], keys):
                raise ValueError(f"{name} has the keys {t['keys']}")
            delta = {"folder": folder, "key_schema": _plain(own.schema).jsonValue(), "schema": self.grow(t, e)["schemas"].index(e["file_schema"])}
            return {**self.grow(t, e), "keys": keys, "deltas": [*t["deltas"], delta], "delta_rows": t["delta_rows"] + n}

        self.changes.append((name, change))

    def note(self, name: str, key: str, value: object) -> None:
        """Keeps a small value with a table."""
        self.changes.append((name, lambda t: {**t, "notes": {**t["notes"], key: value}}))

    def _applied(self, tables: dict[str, State]) -> dict[str, State]:
        out = copy.deepcopy(tables)
        for name, change in self.changes:
            out[name] = change(out.get(name) or {"schema": None, "schemas": [], "keys": [], "entries": [], "deltas": [], "rows": 0, "delta_rows": 0, "notes": {}})
        return out

    def read(self, name: str, schema: T.StructType | str | None = None) -> DataFrame:
        """A table with what this transaction has changed so far."""
        return self.store._frame(self._applied(self.store.state()[1]).get(name), schema, None)

    def commit(self, merge: bool = True) -> int:
        if not self.changes:
            return self.store.state()[0]
        for _ in range(TRIES):
            number, tables = self.store.state()
            new = self._applied(tables)
            if put_file(self.store.spark, self.store._commit_path(number + 1), json.dumps(new), overwrite=False):
                break
        else:
            raise Conflict("others commit all the time")
        if merge:
            for name in dict(self.changes):
                t = new[name]
                if t["deltas"] and (t["delta_rows"] > MERGE_AT * t["rows"] or len(t["deltas"]) > MOST_DELTAS):
                    self.store.merge(name)
        self.store.clean(number + 1)
        return number + 1
