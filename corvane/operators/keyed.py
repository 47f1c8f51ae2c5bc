"""An index by key that changes a batch at a time.

Rows lie in buckets by their key's hash.  A batch is written as one more part of the
buckets that it touches, and of no other; a bucket's parts are merged when they are
read, and rewritten as one part when there are too many.  What belongs to the index is
said by numbered version files, of which the last counts: it is moved into place when
all it names has been written, so that a run that breaks off leaves the version before
readable, and a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.errors import IndexStoreError
from corvane.operators.index import IndexStore

#: What a stored row has besides its own columns: the order of its last writing, and the rows of its key that came in with it.
SEQ, VERSION, CAME = "__seq", "__version", "__came"


class Folder:
    """A folder in any of Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark.sparkContext._jvm
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str = "") -> list[str]:
        at = self._at(below)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def place(self, name: str, text: str) -> None:
        """Writes the file whole under another name, then moves it; fails if it is there."""
        at, aside = self._at(name), self._at(f".{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        if self._fs.exists(at) or not self._fs.rename(aside, at):
            self._fs.delete(aside, False)
            raise IndexStoreError(f"{name} of {self.path} was written by another")

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class KeyedIndex(IndexStore):
    """Rows by key at a path; ordinal says where each key was first written.

    A batch is an upsert: of its rows with one key the last counts, by seq, or without
    seq in the order of the rows.  It replaces what the index has for that key, unless
    that has a greater seq; ordinal keeps the least seq (without seq: the number of the
    version that first had the key).  Rows with a null key are one key.  All batches have
    the same columns.  There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 64, max_parts: int = 4, compression: str = "zstd"):
        super().__init__(spark, path, compression)
        self.key, self.buckets, self.max_parts = key, buckets, max_parts

    @property
    def _folder(self) -> Folder:
        return Folder(self.spark, self._at())

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._folder.names("versions") if n.endswith(".json") and not n.startswith(".")]

    def version(self, number: int | None = None) -> dict:
        """What a version is made of, by default the last: number, batch, key, buckets, schema, and the parts of each bucket, oldest first."""
        numbers = self.versions()
        if not numbers:
            return {"number": 0, "batch": None, "key": self.key, "buckets": self.buckets, "schema": None, "parts": {}}
        return json.loads(self._folder.read(f"versions/{number or numbers[-1]:012d}.json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def _commit(self, now: dict, **changed) -> None:
        after = {**now, **changed, "number": now["number"] + 1}
        Folder(self.spark, f"{self._folder.path}/versions").place(f"{after['number']:012d}.json", json.dumps(after))

    def _bucket(self, now: dict) -> Column:
        return F.pmod(F.xxhash64(now["key"]), F.lit(now["buckets"])).cast("int")

    def _write(self, rows: DataFrame, now: dict) -> tuple[str, list[str]]:
        """A new part of the rows' buckets: its name, and which these are.  rows: as _merged() gives them by bucket."""
        name = f"{now['number'] + 1:012d}-{uuid.uuid4().hex}"
        at = f"{self._folder.path}/data/{name}"
        rows.write.option("compression", self.compression).partitionBy("__bucket").parquet(at)
        return name, [x.partition("=")[2] for x in self._folder.names(f"data/{name}") if x.startswith("__bucket=")]

    def _parts(self, now: dict, buckets: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self._folder.path}/data/{p}/__bucket={b}" for b, parts in buckets.items() for p in parts]
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _dealt(self, rows: DataFrame, now: dict) -> DataFrame:
        """Rows by bucket, in which they are merged and written: they are dealt only once."""
        return rows.withColumn("__bucket", self._bucket(now)).repartition("__bucket")

    @staticmethod
    def _merged(rows: DataFrame, key: str) -> DataFrame:
        """One row a key: of the last writing, at the first ordinal; with __bucket if rows have it."""
        by = [c for c in rows.columns if c == "__bucket"] + [key]
        rest = [c for c in rows.columns if c not in (*by, "ordinal", CAME)]
        last = rows.groupBy(*by).agg(F.min("ordinal").alias("ordinal"), F.max_by(F.struct(*rest), F.struct(SEQ, VERSION)).alias("x"), F.sum(CAME).alias(CAME))
        return last.select(*by, "ordinal", *(F.col(f"x.{c}").alias(c) for c in rest), CAME)

    def _batch(self, rows: DataFrame, now: dict, seq: str | None) -> DataFrame:
        number = now["number"] + 1
        order = F.col(seq) if seq else F.monotonically_increasing_id()
        marked = rows.drop("ordinal").withColumns({SEQ: order.cast("long"), VERSION: F.lit(number).cast("long"), CAME: F.lit(1).cast("long")}).drop(*([seq] if seq and seq != now["key"] else []))
        once = self._merged(self._dealt(marked.withColumn("ordinal", F.col(SEQ)), now), now["key"])
        return once if seq else once.withColumns({SEQ: F.lit(number).cast("long"), "ordinal": F.lit(number).cast("long")})

    def upsert(self, rows: DataFrame, seq: str | None = None, batch: int | None = None) -> int:
        """Writes a batch; how many rows came in.  A batch whose number is not above the last one's was here before, and nothing is written."""
        now = self.version()
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return 0
        once = self._batch(rows, now, seq)
        if now["schema"] is not None:
            had = [f["name"] for f in json.loads(now["schema"])["fields"]]
            came_with = {c for c in once.columns if c != "__bucket"}
            if set(had) != came_with:
                raise IndexStoreError(f"columns differ from the index's: {sorted(set(had) ^ came_with)}")
            once = once.select("__bucket", *had)
        name, touched = self._write(once, now)
        parts = {**now["parts"], **{b: [*now["parts"].get(b, []), name] for b in touched}}
        schema = now["schema"] or once.drop("__bucket").schema.json()
        self._commit(now, parts=parts, schema=schema, batch=now["batch"] if batch is None else batch)
        came = self._parts({**now, "schema": schema}, {b: [name] for b in touched}).agg(F.sum(CAME).alias("n")).first()["n"] or 0
        self.compact(self.max_parts)
        return came

    def compact(self, max_parts: int = 1) -> list[str]:
        """Rewrites the buckets that have more parts as one; which these are."""
        now = self.version()
        many = {b: parts for b, parts in now["parts"].items() if len(parts) > max_parts}
        if many:
            name, _ = self._write(self._merged(self._dealt(self._parts(now, many), now), now["key"]), now)
            self._commit(now, parts={**now["parts"], **{b: [name] for b in many}})
        return sorted(many)

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last versions, and what they don't name; how many parts went."""
        numbers, folder = self.versions(), self._folder
        kept = [self.version(n) for n in numbers[-keep:]]
        named = {p for v in kept for parts in v["parts"].values() for p in parts}
        for n in numbers[:-keep]:
            folder.remove(f"versions/{n:012d}.json")
        gone = [p for p in folder.names("data") if p not in named]
        for p in gone:
            folder.remove(f"data/{p}")
        return len(gone)

    def load(self, number: int | None = None) -> DataFrame:
        """The index, or an older version that is still there: one row a key.  Only buckets of several parts are merged."""
        now = self.version(number)
        if now["schema"] is None:
            raise IndexStoreError(f"no index at {self.path}")
        one, many = ({b: p for b, p in now["parts"].items() if (len(p) > 1) == several} for several in (False, True))
        found = self._parts(now, one)
        if many:
            found = found.unionByName(self._merged(self._parts(now, many), now["key"]))
        return found.drop(SEQ, VERSION, CAME)

    def save(self, rows: DataFrame, reinit: bool = True) -> None:
        """Replaces the index, or with reinit false upserts."""
        if not reinit:
            self.upsert(rows)
            return
        now = {**self.version(), "parts": {}, "schema": None, "key": self.key, "buckets": self.buckets}
        once = self._batch(rows, now, None)
        name, touched = self._write(once, now)
        self._commit(now, parts={b: [name] for b in touched}, schema=once.drop("__bucket").schema.json())


def open_index(spark: SparkSession, path: str) -> IndexStore:
    """The index at a path, whichever way it was written."""
    keyed = KeyedIndex(spark, path)
    return keyed if keyed.exists() else IndexStore(spark, path)
