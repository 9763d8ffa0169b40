"""A ledger of tables that many jobs add to at once, kept as a log of numbered manifests.

A job writes its tables to folders of its own and then one manifest, under the number after
the snapshot that it decided on.  A manifest is made only if none of its number is there, so
of two jobs that decided on one snapshot the second has to look again: it takes the newer
snapshot and decides anew.  Readers name a snapshot and see whole jobs up to it, whatever
is being written; a job that broke off has no manifest and is never seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MANIFEST = "version long, job string, part string, tables array<string>"


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._log = self._path("_log")
        self._files = self._log.getFileSystem(self._conf)
        self._files.mkdirs(self._log)

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def version(self) -> int:
        """The number of the newest snapshot; 0 before the first."""
        names = (s.getPath().getName() for s in self._files.listStatus(self._log))
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _create(self, version: int, text: str) -> bool:
        """Makes a manifest unless there is one of its number: written beside, then linked or moved as a whole."""
        final, beside = self._path("_log", f"{version:020}.json"), self._path("_log", f"_{uuid.uuid4().hex}")
        out = self._files.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._files.getUri().getScheme() == "file":
                local = lambda p: self._jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
                self._jvm.java.nio.file.Files.createLink(local(final), local(beside))
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(beside, final, none)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self._files.delete(beside, False)

    def manifests(self, version: int) -> DataFrame:
        """The manifests of a snapshot, a row each."""
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).json(f"{self.root}/_log/[0-9]*.json").filter(F.col("version") <= version)

    def has(self, job: str, version: int) -> bool:
        return bool(self.manifests(version).filter(F.col("job") == job).limit(1).count())

    def table(self, name: str, version: int, schema: str) -> DataFrame:
        """A table as a snapshot has it, with ``part`` for the folder that each row came in."""
        folder = self._path(name)
        if not version or not self._files.exists(folder):
            return self.spark.createDataFrame([], schema + ", part string")
        rows = self.spark.read.schema(schema + ", part string").option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        # few manifests to many rows: the parts are pruned by the join
        return rows.join(self.manifests(version).select("part"), "part", "left_semi")

    def commit(self, job: str, decide: Callable[[int], dict[str, DataFrame]], tries: int = 20) -> int | None:
        """Adds what ``decide`` makes of a snapshot, as one; null if ``job`` is there already.

        ``decide`` is called again whenever another job was first.
        """
        for _ in range(tries):
            version = self.version()
            if self.has(job, version):
                return None
            part = uuid.uuid4().hex
            tables = decide(version)
            for name, df in tables.items():
                df.write.parquet(f"{self.root}/{name}/part={part}")
            manifest = {"version": version + 1, "job": job, "part": part, "tables": list(tables)}
            if self._create(version + 1, json.dumps(manifest)):
                return version + 1
            for name in tables:
                self._files.delete(self._path(name, f"part={part}"), True)
        raise RuntimeError("other jobs were first every time")


def register(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """Insert-or-get of artifacts: incoming files (digest, content, filename) against those ``held``.

    Adds ``outcome``: NEW for the first of a digest that isn't held, GOT for one with the held
    (or first) one's bytes, content_digest_collision for other bytes.  Contents are compared
    byte by byte, only where digests meet.
    """
    there = held.select(F.col("digest").alias("__digest"), F.col("content").alias("__content"))
    first = incoming.groupBy(F.col("digest").alias("__d")).agg(F.min("filename").alias("__first"), F.min_by("content", "filename").alias("__own"))
    rows = incoming.join(first, F.col("digest") == F.col("__d")).join(there, F.col("digest") == F.col("__digest"), "left")
    same = F.col("content") == F.coalesce("__content", "__own")
    # of one name in several places one is new
    nth = F.row_number().over(Window.partitionBy("digest", "filename").orderBy("filename", *(c for c in incoming.columns if c not in ("digest", "filename", "content"))))
    rows = rows.withColumn("__new", F.col("__digest").isNull() & (F.col("filename") == F.col("__first"))).withColumn("__nth", nth)
    outcome = F.when(~same, "content_digest_collision").when(F.col("__new") & (F.col("__nth") == 1), "NEW").otherwise("GOT")
    return rows.select(*incoming.columns, outcome.alias("outcome"))
