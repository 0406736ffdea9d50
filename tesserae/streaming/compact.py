"""Consolidating many small files into few (problem 3): a checkpointed streaming compactor.

The file source discovers each file once (its log lies in the checkpoint), every trigger takes the files available, and
``foreachBatch`` writes a batch to ``stage/batch=<id>``, replacing that folder: a batch that is retried after a failure
overwrites what it left behind. :meth:`Compactor.merge` then writes every distinct record once, in files of about
``target_bytes`` (smaller ones, down to ``least_bytes``, where there would be fewer files than cores), each sorted on the
sort columns so that its row groups can be skipped by them. The merged set is a folder a generation: readers see the one
that ``CURRENT`` names, which is replaced by a rename once the next is complete, so a merge that fails changes nothing.

Records are equal when all columns but ``key`` and ``origin`` are (null equals null, NaN equals NaN); the one with the
smallest key stays. Equal records meet in a hash aggregate with map-side combination, so a record written any number of
times costs one row a task. That aggregate's own shuffle has as many partitions as there will be files, so it is the only
one, and a task's rows are those of one file at any size of the table.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.plans.scale import shared_dir


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's SQL settings changed for a while; names with ``__`` for the dots."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass
class Compactor:
    """``source``: a folder, file or glob of Parquet files. ``work``: a folder shared by all executors; the state of the
    stream lies there, so a compactor made again with the same folder goes on where the last one stopped."""

    spark: SparkSession
    source: str
    work: str
    key: str = "pred_id"
    origin: str = "file_id"
    sort: tuple[str, ...] = ("date", "upprobability")
    target_bytes: int = 128 << 20
    least_bytes: int = 16 << 20
    files_per_batch: int = 20_000

    @classmethod
    def fresh(cls, spark: SparkSession, source: str, **more) -> Compactor:
        """A compactor with a new work folder below the cluster's shared one."""
        return cls(spark, source, f"{shared_dir(spark)}/compact-{uuid.uuid4().hex}", **more)

    @cached_property
    def schema(self) -> T.StructType:
        return self.spark.read.parquet(self.source).schema

    @property
    def staged(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.work}/stage")

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.work}/stage/batch={batch_id:09d}")

    def ingest(self) -> Compactor:
        """Stage all files that are there now and were not before; returns when none is left."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(self._pattern())
        query = stream.writeStream.foreachBatch(self._write).option("checkpointLocation", f"{self.work}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def distinct(self) -> DataFrame:
        """Every distinct staged record once, with its smallest key and that row's origin."""
        rows = self.staged
        content = [c for c in rows.columns if c not in (self.key, self.origin)]
        aggs = [F.min(self.key).alias(self.key)]
        if self.origin in rows.columns:
            aggs.append(F.coalesce(F.min_by(self.origin, self.key), F.min(self.origin)).alias(self.origin))
        return rows.groupBy(*content).agg(*aggs).select(*rows.columns)

    def merge(self) -> DataFrame:
        """Write the distinct records to a new generation, make it the current one and return it as read back. Batches that
        are all in the current one already are not merged again."""
        batches, size = self._batches(), self._bytes(f"{self.work}/stage")
        generation, done = self._current()
        if generation is None or done != batches:
            cores = self.spark.sparkContext.defaultParallelism
            parts = max(1, math.ceil(size / self.target_bytes), min(cores, math.ceil(size / self.least_bytes)))
            following = 0 if generation is None else generation + 1
            with settings(self.spark, spark__sql__shuffle__partitions=str(parts), spark__sql__adaptive__coalescePartitions__enabled="false"):
                self.distinct().sortWithinPartitions(*self.sort, self.key).write.mode("overwrite").option("compression", "zstd").parquet(self._folder(following))
            self._point(following, batches)
            if generation:
                self._delete(self._folder(generation - 1))  # readers may still be in the last one
        return self.merged

    @property
    def merged(self) -> DataFrame:
        generation, _ = self._current()
        if generation is None:
            raise ValueError("nothing has been merged")
        return self.spark.read.schema(self.schema).parquet(self._folder(generation))

    def surplus(self) -> DataFrame:
        """The staged rows that are no part of ``merged``: keys are unique, so this join has no skew. Rows with a null key
        have no name and are not listed."""
        return self.staged.where(F.col(self.key).isNotNull()).join(self.merged.select(self.key), self.key, "left_anti")

    def _folder(self, generation: int) -> str:
        return f"{self.work}/merged/generation={generation:09d}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> int:
        """The number of staged batches; they are numbered without gaps and never change."""
        p, fs = self._fs(f"{self.work}/stage")
        return len(fs.listStatus(p)) if fs.exists(p) else 0

    def _current(self) -> tuple[int | None, int]:
        """(generation, batches in it) that ``CURRENT`` names."""
        p, fs = self._fs(f"{self.work}/CURRENT")
        if not fs.exists(p):
            return None, 0
        stream = fs.open(p)
        try:
            generation, batches = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode().split()
        finally:
            stream.close()
        return int(generation), int(batches)

    def _point(self, generation: int, batches: int) -> None:
        """Make ``CURRENT`` name a generation: written beside it, then renamed over it."""
        jvm = self.spark.sparkContext._jvm
        beside, fs = self._fs(f"{self.work}/CURRENT.next")
        out = fs.create(beside, True)
        try:
            out.write(bytearray(f"{generation} {batches}".encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(beside, self._fs(f"{self.work}/CURRENT")[0], options)

    def _delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    def _pattern(self) -> str:
        """The source; a single file as a glob of itself, as the stream takes folders and globs only."""
        p, fs = self._fs(self.source)
        return f"{self.source[:-1]}[{self.source[-1]}]" if fs.exists(p) and fs.getFileStatus(p).isFile() else self.source

    def _bytes(self, path: str) -> int:
        p, fs = self._fs(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def compact(spark: SparkSession, source: str, **more) -> Compactor:
    """Stage and merge ``source`` in a new work folder."""
    done = Compactor.fresh(spark, source, **more).ingest()
    done.merge()
    return done
