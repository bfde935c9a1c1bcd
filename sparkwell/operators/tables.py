"""Tables on disk: one whose changes write only the partitions that they touch, and one whose states are whole.

All is written by Spark's own writers. One writer of a table at a time is assumed.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constraints
from .events import numbered

#: Partitions of a table; a table's own number is kept with it.
PARTS = 64

_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A new name in the folder that driver and executors share (``spark.checkpoint.dir``); unset, a local session uses a temporary one, any other the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="sparkwell-")) if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/sparkwell-work/{uuid.uuid4().hex}"


def write_counted(write: Callable[[DataFrame], None], rows: DataFrame, figures: dict[str, Column] | None = None) -> dict[str, object]:
    """Writes ``rows`` and gives ``figures`` (aggregates) of what was written, without another pass; ``n`` is the number of rows."""
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in (figures or {}).items()]))
    return seen.get


@dataclass(frozen=True)
class Folder:
    """What Spark's file systems do that its writers don't."""

    spark: SparkSession
    path: str

    def _of(self, name: str):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str = "") -> bool:
        _, path, fs = self._of(name)
        return fs.exists(path)

    def drop(self, name: str = "") -> None:
        _, path, fs = self._of(name)
        fs.delete(path, True)

    def value(self, name: str) -> dict:
        """A small JSON file; empty if it isn't there."""
        return json.loads(self.spark.read.text(f"{self.path}/{name}").first()[0]) if self.has(name) else {}

    def replace(self, name: str, value: dict) -> None:
        """The file is replaced by a rename, so a reader finds the old or the new one."""
        jvm, path, fs = self._of(name)
        _, draft, _ = self._of(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(json.dumps(value).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, path, options)


@dataclass(frozen=True)
class SnapshotTable:
    """Whole states of a table in numbered folders; a pointer names the current one.

    Readers take the pointer once. A state stays for one more write, then it goes.
    """

    spark: SparkSession
    path: str
    schema: T.StructType

    def version(self) -> int:
        return Folder(self.spark, self.path).value("CURRENT").get("version", 0)

    def read(self) -> DataFrame:
        n = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{n}") if n else self.spark.createDataFrame([], self.schema)

    def write(self, state: DataFrame, figures: dict[str, Column] | None = None, parents: dict[str, DataFrame] | None = None) -> dict[str, object]:
        """The next state, complete and checked before the pointer names it; ``figures`` of it and its number of rows."""
        n, here = self.version() + 1, Folder(self.spark, self.path)
        rows = state.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], *[c for c in state.columns if c.startswith("_seen")])
        seen = write_counted(lambda df: df.drop(*[c for c in df.columns if c.startswith("_seen")]).write.mode("overwrite").parquet(f"{self.path}/v{n}"), rows, figures)
        if any(not f.nullable or f.metadata for f in self.schema):
            constraints.check(self.spark.read.parquet(f"{self.path}/v{n}"), self.schema, parents=parents)
        here.replace("CURRENT", {"version": n})
        here.drop(f"v{n - 2}")
        return seen


@dataclass(frozen=True)
class PartitionedTable:
    """Rows in partitions by a hash of ``key``, sorted by it within a file, with Bloom filters on ``blooms``.

    New rows are appended. A change reads the partitions of the keys that it is given, writes their new rows aside, names them in a small
    file, and only then replaces them by a dynamic partition overwrite; what was interrupted after that is done again by the next use.
    Numbers for new rows come from a stored mark that only rises, so those of deleted rows don't come back.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str = "article_id"
    parts: int = PARTS
    blooms: tuple[str, ...] = ()
    parents: dict[str, PartitionedTable] = field(default_factory=dict)

    @property
    def _here(self) -> Folder:
        return Folder(self.spark, self.path)

    def number_of_parts(self) -> int:
        """That with which the table was begun."""
        return self._here.value("PARTS").get("parts", self.parts)

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("long")), F.lit(self.number_of_parts())).cast("int")

    def _scan(self) -> DataFrame:
        """With ``part``, by which Spark leaves out folders."""
        self._finish()
        whole = T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])
        return self.spark.read.schema(whole).parquet(f"{self.path}/rows") if self._here.has("rows") else self.spark.createDataFrame([], whole)

    def read(self) -> DataFrame:
        return self._scan().select(*self.schema.names)

    def touched(self, keys: DataFrame) -> list[int]:
        """The partitions of these keys; as many as there are partitions at most."""
        return sorted(r[0] for r in keys.select(self.part(F.col(self.key)).alias("p")).distinct().collect())

    def of_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of all ``keys``, from their partitions alone."""
        return self._scan().filter(F.col("part").isin(self.touched(keys))).select(*self.schema.names).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def of_key(self, key: int) -> DataFrame:
        own = F.lit(key).cast("long")
        return self._scan().filter((F.col("part") == self.part(own)) & (F.col(self.key) == own)).select(*self.schema.names)

    def of_values(self, column: str, values: DataFrame) -> DataFrame:
        """The rows with any of ``values`` (a column of the same name), by a semi-join."""
        return self.read().join(values.select(column).distinct(), column, "left_semi")

    def where_equal(self, column: str, value: object) -> DataFrame:
        """The rows with this value; files and row groups are left out by their Bloom filters or least and greatest values."""
        return self.read().filter(F.col(column) == value)

    def _write(self, rows: DataFrame, path: str, mode: str, figures: dict[str, Column] | None = None) -> dict[str, object]:
        extra = [c for c in rows.columns if c.startswith("_seen")]  # what figures are made of and the table doesn't have
        own = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], self.part(F.col(self.key)).alias("part"), *extra)
        # a partition with many rows is dealt to several tasks
        dealt = own.hint("rebalance", "part").sortWithinPartitions("part", self.key)

        def save(df: DataFrame) -> None:
            out = df.drop(*extra).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part")
            for c in self.blooms:
                out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
            out.parquet(path)

        return write_counted(save, dealt, figures)

    def _begin(self) -> None:
        if not self._here.has("PARTS"):
            self._here.replace("PARTS", {"parts": self.parts})

    def _check(self, rows: DataFrame, stored: DataFrame | None, columns: list[str] | None = None) -> None:
        constraints.check(rows, self.schema, stored, {n: t.read() for n, t in self.parents.items()}, columns)

    def append(self, rows: DataFrame, checked: bool = True) -> int:
        """New rows, which are checked against the stored ones; how many. ``rows`` are read twice, so they should be written ones."""
        self._begin()
        if checked:
            self._check(rows, self.read())
        return self._write(rows, f"{self.path}/rows", "append")["n"]

    def insert(self, rows: DataFrame, order: str, figures: dict[str, Column] | None = None) -> tuple[DataFrame, dict[str, object]]:
        """Appends rows without a key, which get theirs in ``order``; the rows as they were stored, and ``figures`` of them with their number ``n``."""
        self._begin()
        start = self.greatest()
        staged, columns = f"{work_dir(self.spark)}-new", list(self.schema.names)
        own = numbered(rows, order, self.key, start)
        seen = write_counted(lambda df: df.select(*columns).write.parquet(staged), own, figures)
        new = self.spark.read.schema(self.schema).parquet(staged)
        if seen["n"]:
            # the mark first: a number that was given out is never given again, whatever becomes of its row
            self._here.replace("GREATEST", {"greatest": start + seen["n"]})
            self.append(new)
        return new, seen

    def greatest(self) -> int:
        """The greatest key that was ever given."""
        mark = self._here.value("GREATEST").get("greatest")
        return (self.read().agg(F.max(self.key)).first()[0] or 0) if mark is None else mark

    def change(self, keys: DataFrame, state: Callable[[DataFrame], DataFrame], figures: dict[str, Column] | None = None, columns: list[str] | None = None) -> dict[str, object]:
        """The partitions of ``keys`` become what ``state`` makes of their rows; ``figures`` of the new rows.

        ``columns`` are those that may have new values and are checked (all, if it isn't given). ``keys`` are read once for their
        partitions, and ``state`` may use written tables only, so that it gives the same rows again.
        """
        self._begin()
        self._finish()
        touched = self.touched(keys)
        if not touched:
            return {"n": 0} | {k: None for k in figures or {}}
        there = F.col("part").isin(touched)
        seen = self._write(state(self._scan().filter(there).select(*self.schema.names)), f"{self.path}/pending/rows", "overwrite", figures)
        if seen["n"]:
            self._check(self.spark.read.parquet(f"{self.path}/pending/rows"), self._scan().filter(~there), columns)
        self._here.replace("pending/TOUCHED", {"touched": touched})
        self._finish()
        return seen

    def _finish(self) -> None:
        """Carries out a change that is complete beside the table."""
        here = self._here
        if not here.has("pending/TOUCHED"):
            return
        touched = here.value("pending/TOUCHED")["touched"]
        filled = [p for p in touched if here.has(f"pending/rows/part={p}")]
        if filled:
            whole = T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])
            self._write(self.spark.read.schema(whole).parquet(f"{self.path}/pending/rows"), f"{self.path}/rows", "overwrite")
        for p in sorted(set(touched) - set(filled)):
            here.drop(f"rows/part={p}")
        here.drop("pending")

    def delete(self, keys: DataFrame) -> int:
        """Removes the rows of ``keys``; how many."""
        gone = keys.select(F.col(self.key).cast("long").alias(self.key)).distinct()
        n = self._scan().filter(F.col("part").isin(self.touched(gone))).select(self.key).join(gone, self.key, "left_semi").agg(F.count(F.lit(1))).first()[0]
        if n:
            self.change(gone, lambda old: old.join(gone, self.key, "left_anti"), columns=[])
        return n
