"""Verdicts kept from run to run in buckets of their content key.

The store is never shuffled: a run deals its own few distinct keys to the store's buckets and
reads the buckets as they lie. New verdicts are appended as one file per bucket; a compaction
writes a new generation with one sorted file per bucket, and readers of the old one go on.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenumlens.operators.evaluation import FAILED, VERDICT_FIELDS, lookup_verdicts
from plenumlens.operators.ranking import first_per_key
from plenumlens.schemas import VERDICT

#: Buckets of a new store; each is one task of a lookup.
BUCKETS = 64

_COMPLETE = "_COMPLETE"


class VerdictStore:
    """Verdicts by content key below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """Open the store at ``path``, or make it; an existing one keeps its number of buckets."""
        self.spark, self.path = spark, path.rstrip("/")
        found = self._generations()
        if not found:
            self._finish(1, buckets)
            found = [(1, buckets)]
        self.generation, self.buckets = found[-1]
        self._register(self.generation, self.buckets)

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _generations(self) -> list[tuple[int, int]]:
        """(number, buckets) of the generations that were finished, in order."""
        files, path = self._files()
        root = path(self.path)
        if not files.exists(root):
            return []
        names = [s.getPath().getName() for s in files.listStatus(root)]
        parsed = [(int(m[1]), int(m[2]), n) for n in names if (m := re.fullmatch(r"generation-(\d+)-of-(\d+)", n))]
        return sorted((g, b) for g, b, n in parsed if files.exists(path(f"{self.path}/{n}/{_COMPLETE}")))

    def _folder(self, generation: int, buckets: int) -> str:
        return f"{self.path}/generation-{generation:06d}-of-{buckets}"

    def _finish(self, generation: int, buckets: int) -> None:
        files, path = self._files()
        files.create(path(f"{self._folder(generation, buckets)}/{_COMPLETE}")).close()

    def _register(self, generation: int, buckets: int) -> str:
        """The generation as a table of this session's catalog, which then knows its buckets."""
        folder = self._folder(generation, buckets)
        name = f"verdicts_{hashlib.md5(folder.encode()).hexdigest()}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (content_key string, {VERDICT}) USING parquet "
                       f"CLUSTERED BY (content_key) SORTED BY (content_key) INTO {buckets} BUCKETS LOCATION '{folder}'")
        self.table = name
        return name

    def verdicts(self) -> DataFrame:
        """All stored verdicts, dealt by their key as they lie."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def known(self, keys: DataFrame) -> DataFrame:
        """The stored verdicts of the rows' ``content_key``; only these keys are shuffled, each once."""
        distinct = keys.select("content_key").where("content_key IS NOT NULL").distinct().repartition(self.buckets, "content_key")
        return self.verdicts().join(distinct, "content_key", "left_semi")

    def lookup(self, keyed: DataFrame) -> DataFrame:
        """``keyed`` with stored verdicts and ``cached``; copies of one text may be any share of the rows."""
        return lookup_verdicts(keyed, self.known(keyed))

    def append(self, fresh: DataFrame) -> None:
        """Add the verdicts of keys that have none yet; a failed verdict is not kept, of several for a key the least row is."""
        rows = fresh.where((F.col("api_used") != FAILED) & F.col("content_key").isNotNull()).select("content_key", *VERDICT_FIELDS)
        one = first_per_key(rows, ["content_key"], VERDICT_FIELDS).repartition(self.buckets, "content_key")
        new = one.join(self.verdicts().select("content_key"), "content_key", "left_anti")
        new.select("content_key", *VERDICT_FIELDS).write.insertInto(self.table)

    def compact(self, buckets: int | None = None) -> None:
        """Write a new generation with one sorted file per bucket, on demand of another number of buckets.

        It counts once it is marked as finished, so a compaction that breaks off changes nothing;
        the generation before it stays for whoever reads it, older ones go.
        """
        old, wanted = (self.generation, self.buckets), buckets or self.buckets
        rows = self.verdicts()
        files, path = self._files()
        generation = self.generation + 1
        files.delete(path(self._folder(generation, wanted)), True)  # of a compaction that broke off
        table = self._register(generation, wanted)
        one = first_per_key(rows, ["content_key"], VERDICT_FIELDS)
        one.select("content_key", *VERDICT_FIELDS).repartition(wanted, "content_key").write.insertInto(table)
        self._finish(generation, wanted)
        self.generation, self.buckets = generation, wanted
        for number, count in self._generations():
            if number < old[0]:
                files.delete(path(self._folder(number, count)), True)
