"""Tables in versions: each is a list of parts, and a new version is one small file that appears at once or not at all.

A part is a folder that is never written again: rows, and keys (a row for each key, as a book, that the part holds or removes).
A key's rows are those of the last part that names it, so replacing books writes only these, and deletes are parts without
rows. The log has a file for each version, with the parts of every table; it is written beside and renamed to its number, which fails
if that version is there. So readers see whole versions only, of all tables together; a writer that is lost midway leaves
folders that no version names; of two writers that began at one version, one is refused.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a table from which on compact() is worth its cost.
MANY_PARTS = 8


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Versions:
    """The versions of some tables below one folder of a store that Hadoop can write."""

    def __init__(self, spark: SparkSession, path: str, key: str = "book"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(self._conf)

    # --- the log ---

    def _log(self, version: int | str) -> str:
        return f"{self.path}/_log/{version:012d}.json" if isinstance(version, int) else f"{self.path}/_log/{version}"

    def latest(self) -> int:
        """The last version; 0 before the first."""
        folder = self._at(f"{self.path}/_log")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def entry(self, version: int | None = None) -> dict:
        """What a version (the last) is: its tables' parts, and what its writer noted."""
        version = self.latest() if version is None else version
        if not version:
            return {"tables": {}, "note": {}}
        stream = self._fs.open(self._at(self._log(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, base: int, tables: dict[str, list[dict]], note: dict | None = None) -> int:
        """The version after base: its tables with these parts, the others as in base."""
        entry = {"tables": self.entry(base)["tables"] | tables, "note": note or {}}
        beside = self._at(self._log(f".{uuid.uuid4().hex}"))
        stream = self._fs.create(beside, True)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(beside, self._at(self._log(base + 1)), none)
        except Exception as e:
            self._fs.delete(beside, False)
            if self._fs.exists(self._at(self._log(base + 1))):
                raise Conflict(f"version {base + 1} of {self.path} is there") from e
            raise
        return base + 1

    def noted(self, name: str, value) -> int | None:
        """The last version whose note has that value."""
        return next((v for v in range(self.latest(), 0, -1) if self._fs.exists(self._at(self._log(v))) and self.entry(v)["note"].get(name) == value), None)

    # --- parts ---

    def part(self, seq: int, **more) -> dict:
        return {"seq": seq, "name": f"part-{uuid.uuid4().hex}"} | more

    def folder(self, part: dict) -> str:
        return f"{self.path}/{part['name']}"

    def dataset(self, part: dict, name: str) -> DataFrame:
        """A dataset of a part, by the schema that the part notes, or by its files'."""
        reader, schema = self.spark.read, part.get("schemas", {}).get(name)
        return (reader.schema(StructType.fromJson(schema)) if schema else reader).parquet(f"{self.folder(part)}/{name}")

    def keys(self, table: str, version: int | None = None) -> DataFrame | None:
        """(key, seq, rows, digest) of all keys that a table holds, by the part that has their rows."""
        parts = self.entry(version)["tables"].get(table)
        if not parts:
            return None
        named = [self.spark.read.parquet(f"{self.folder(p)}/keys").withColumn("seq", F.lit(p["seq"])) for p in parts]
        last = reduce(DataFrame.unionByName, named).groupBy("key").agg(F.max_by(F.struct("seq", "rows", "digest"), "seq").alias("k"))
        return last.select("key", "k.*").where("rows > 0")

    def live(self, table: str, dataset: str, key: str, version: int | None = None, parts: list[dict] | None = None) -> DataFrame | None:
        """A dataset of a table's parts, without the rows of keys that a later part replaces or removes."""
        every = self.entry(version)["tables"].get(table)
        if not every:
            return None
        read = [self.dataset(p, dataset).withColumn("_seq", F.lit(p["seq"])) for p in (every if parts is None else parts)]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)
        if len(every) > 1:
            held = self.keys(table, version).select(F.col("key").alias("_key"), F.col("seq").alias("_live"))
            rows = rows.join(held, (F.col(key) == F.col("_key")) & (F.col("_seq") == F.col("_live")), "left_semi")
        return rows.drop("_seq")

    # --- tables of rows ---

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The table's rows in that version (the last); null if it has no such table."""
        return self.live(table, "rows", self.key, version)

    def write_part(self, rows: DataFrame, seq: int, removed: DataFrame | None = None) -> dict:
        part = self.part(seq)
        rows.repartition(self.key).sortWithinPartitions(self.key).write.parquet(f"{self.folder(part)}/rows")
        own = self.spark.read.parquet(f"{self.folder(part)}/rows").groupBy(F.col(self.key).alias("key")).agg(F.count(F.lit(1)).alias("rows")).withColumn("digest", F.lit(None).cast("string"))
        if removed is not None:
            own = own.unionByName(removed.select(F.col(self.key).alias("key")).distinct().join(own.select("key"), "key", "left_anti").select("key", F.lit(0).cast("long").alias("rows"), F.lit(None).cast("string").alias("digest")))
        own.write.parquet(f"{self.folder(part)}/keys")
        return part

    def overwrite(self, note: dict | None = None, **tables: DataFrame) -> int:
        """S3. A version in which these tables are these rows."""
        base = self.latest()
        return self.commit(base, {name: [self.write_part(rows, 1)] for name, rows in tables.items()}, note)

    def replace(self, note: dict | None = None, removed: dict[str, DataFrame] | None = None, **tables: DataFrame) -> int:
        """S3. A version in which the keys of these rows have these rows, and `removed` keys none; the others are as they were."""
        base, removed = self.latest(), removed or {}
        before, after = self.entry(base)["tables"], {}
        for name, rows in tables.items():
            parts = before.get(name, [])
            after[name] = [*parts, self.write_part(rows, max([p["seq"] for p in parts], default=0) + 1, removed.get(name))]
        return self.commit(base, after, note)

    def compact(self, *tables: str, at_least: int = MANY_PARTS) -> int:
        """S4. Tables of many parts as one each; the last version, if there is none."""
        base = self.latest()
        before = self.entry(base)["tables"]
        many = [t for t in tables or before if len(before.get(t, [])) >= at_least]
        return self.commit(base, {t: [self.write_part(self.read(t, base), 1)] for t in many}, {"compacted": many}) if many else base

    def rollback(self, version: int) -> int:
        """A version whose tables are those of an earlier one: no rows are written."""
        base, gone = self.latest(), self.entry(version)["tables"]
        return self.commit(base, {t: gone.get(t, []) for t in self.entry(base)["tables"] | gone}, {"rolled_back_to": version})

    def vacuum(self, keep: list[int]) -> list[str]:
        """Delete the parts that neither the last version nor one of these names; what is deleted."""
        named = {p["name"] for v in {*keep, self.latest()} for parts in self.entry(v)["tables"].values() for p in parts}
        there = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        gone = [n for n in there if n.startswith("part-") and n not in named]
        for n in gone:
            self._fs.delete(self._at(f"{self.path}/{n}"), True)
        return gone
