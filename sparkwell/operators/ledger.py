"""A ledger of a model's replies: what was answered once isn't asked again, whatever becomes of the task or the job that asked.

A reply is written by the task that got it, a few requests at a time, under a key of model, rules, form and request. Later runs read it
from there, and so does the next attempt of a task that was lost.
"""

from __future__ import annotations

import fcntl
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Folder

SCHEMA = "key string, raw string, error string, run string"
_ARROW = pa.schema([("key", pa.string()), ("raw", pa.string()), ("error", pa.string()), ("run", pa.string())])


@contextmanager
def slot(name: str, n: int) -> Iterator[None]:
    """One of ``n`` places that the Python workers of a machine share; waits for one. A place is free again when its holder ends, however it ends."""
    while True:
        for i in range(n):
            with open(os.path.join(tempfile.gettempdir(), f"sparkwell-{name}-{i}.lock"), "w") as f:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                except BlockingIOError:
                    continue
                yield
                return
        time.sleep(0.02)


@dataclass(frozen=True)
class Ledger:
    """``path`` is a folder that driver and executors share, on a file system that both Spark and pyarrow know (file, hdfs, s3, gs).

    ``model`` is part of every key. ``batch`` requests are asked before their replies are written; at most ``in_flight`` requests of an
    executor's tasks are under way at a time.
    """

    spark: SparkSession
    path: str
    model: str
    batch: int = 16
    in_flight: int = 8

    def key(self, rules: str, form: str, request: Column) -> Column:
        return F.sha2(F.concat_ws("\0", F.lit(self.model), F.lit(rules), F.lit(form), request), 256)

    def _open(self) -> list[str]:
        """Folders of runs that were not brought to their end."""
        jvm, path, fs = Folder(self.spark, self.path)._of("open")
        return [s.getPath().toString() for s in fs.listStatus(path)] if fs.exists(path) else []

    def read(self) -> DataFrame:
        """key, raw, error and run of all replies so far; a key may have failed more than once before it was answered."""
        folders = [*([f"{self.path}/done"] if Folder(self.spark, self.path).has("done") else []), *self._open()]
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def known(self) -> DataFrame:
        """key and raw of what was answered, a row per key."""
        return self.read().filter("error is null").groupBy("key").agg(F.max("raw").alias("raw"))

    def ask(self, requests: DataFrame, make: Callable[[], Callable[[str], str]]) -> DataFrame:
        """key, raw and error of what is in the ledger then; each different one of ``requests`` (key and request; a written table) is asked once, and only if it isn't known.

        ``make`` makes what answers, once per task that asks. Any Exception that it raises is the request's error; it is asked again in later runs.
        """
        run = uuid.uuid4().hex
        folder = f"{self.path}/open/{run}"
        todo = requests.select("key", "request").dropDuplicates(["key"]).join(self.known().select("key"), "key", "left_anti")
        # a written reply is a row of the job, but no job is needed to keep it
        todo.mapInArrow(_asker(folder, run, make, self.batch, self.in_flight), "key string").write.format("noop").mode("overwrite").save()
        here = Folder(self.spark, self.path)
        for at in self._open():
            self.spark.read.schema(SCHEMA).parquet(at).hint("rebalance").write.mode("append").parquet(f"{self.path}/done")
            here.drop(f"open/{at.rsplit('/', 1)[-1]}")
        # a row per key: what was answered, else why it wasn't this time
        own = self.read().filter(F.col("error").isNull() | (F.col("run") == run))
        replies = own.groupBy("key").agg(F.max(F.when(F.col("error").isNull(), F.col("raw"))).alias("raw"), F.max("error").alias("error"), F.max(F.col("error").isNull()).alias("_answered"))
        return replies.select("key", "raw", F.when(~F.col("_answered"), F.col("error")).alias("error"))


def _asker(folder: str, run: str, make: Callable[[], Callable[[str], str]], size: int, in_flight: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        context = TaskContext.get()
        own, made = f"{context.partitionId():06d}", 0
        answered: set[str] = set()
        if context.attemptNumber():
            # what an earlier attempt of this task has written stays
            for f in fs.get_file_info(FileSelector(root, allow_not_found=True)):
                if f.type == FileType.File and f.base_name.startswith(f"{own}-"):
                    with fs.open_input_file(f.path) as source:
                        answered.update(pq.read_table(source, columns=["key"]).column("key").to_pylist())
        answer: Callable[[str], str] | None = None
        for b in batches:
            pairs = [x for x in zip(b.column("key").to_pylist(), b.column("request").to_pylist(), strict=True) if x[0] not in answered]
            for at in range(0, len(pairs), size):
                rows: list[tuple] = []
                answer = answer or make()
                try:
                    for key, request in pairs[at : at + size]:
                        with slot("model", in_flight):
                            try:
                                rows.append((key, answer(request), None, run))
                            except Exception as e:  # noqa: BLE001  any failure of a model is a row's error
                                rows.append((key, None, f"{type(e).__name__}: {e}", run))
                finally:
                    if rows:
                        # complete under another name first, then there at once; names that begin with a dot are no data
                        fs.create_dir(root, recursive=True)
                        name = f"{own}-{context.attemptNumber()}-{made:06d}.parquet"
                        pq.write_table(pa.Table.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], _ARROW), f"{root}/.{name}", filesystem=fs)
                        fs.move(f"{root}/.{name}", f"{root}/{name}")
                        made += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string())], ["key"])

    return ask
