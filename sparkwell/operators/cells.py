"""A saved index of vectors in cells, so that a search reads some of them: an inverted file with a measured recall.

Centroids come from a bounded sample; every vector is stored in the cell of its nearest one, and cells are the partitions of a
table. How many cells a question reads is the least number with which questions of a sample found the wanted share of their exact neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .retrieval import CORPUS_BLOCK, QUERY_BLOCK, _all_of, _block, _unit, best_of, matrix, nearest, usable
from .tables import Folder, PartitionedTable, work_dir

#: Vectors that centroids are made of, steps of that, and rows that are compared with all centroids at once.
SAMPLE, STEPS, SLICE = 20_000, 10, 2048
ROWS = T.StructType([T.StructField("article_id", T.LongType(), False, {"unique": True}), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cell", T.IntegerType())])


class CellTable(PartitionedTable):
    """Partitioned by the rows' own cell."""

    def part(self, key: Column) -> Column:
        return F.col("cell")

    def touched(self, keys: DataFrame) -> list[int]:
        """The cells where ``keys`` are stored, and those where they are to go (a column ``cell``)."""
        cells = self._scan().select("article_id", F.col("part").alias("cell")).join(keys.select("article_id"), "article_id", "left_semi").select("cell")
        if "cell" in keys.columns:
            cells = cells.unionByName(keys.select("cell").filter(F.col("cell").isNotNull()))
        return sorted(r[0] for r in cells.distinct().collect())


def centroids_of(x: np.ndarray, n: int) -> np.ndarray:
    """Unit centroids of unit vectors, by cosine; the first ones are spread over the rows, empty ones stay as they are."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(STEPS):
        own = np.concatenate([(x[i : i + SLICE] @ c.T).argmax(axis=1) for i in range(0, len(x), SLICE)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        some = np.linalg.norm(sums, axis=1) > 0
        c[some] = _unit(sums[some])
    return c


def _nearest_cells(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each row, nearest first."""
    out = np.empty((len(x), n), np.int32)
    for i in range(0, len(x), SLICE):
        near = np.round(_unit(x[i : i + SLICE]) @ c.T, 12)
        out[i : i + SLICE] = np.argsort(-near, axis=1, kind="stable")[:, :n]
    return out


@dataclass(frozen=True)
class CellIndex:
    """``build`` it once, then ``search``, ``upsert`` and ``delete``; ``build`` again when vectors have become others than they were."""

    spark: SparkSession
    path: str

    @property
    def _here(self) -> Folder:
        return Folder(self.spark, self.path)

    def built(self) -> bool:
        return self._here.has("CURRENT")

    def about(self) -> dict:
        """version, size (components), cells, probes, recall (as it was measured)."""
        return self._here.value("CURRENT")

    def _rows(self, version: int) -> CellTable:
        return CellTable(self.spark, f"{self.path}/v{version}/cells", ROWS)

    def rows(self) -> DataFrame:
        """article_id, embedding, cell, and part, by which Spark leaves out folders."""
        return self._rows(self.about()["version"])._scan()

    def centroids(self) -> np.ndarray:
        """As many rows as there are cells."""
        found = self.spark.read.parquet(f"{self.path}/v{self.about()['version']}/centroids").orderBy("cell").collect()
        return np.array([r["centroid"] for r in found])

    @staticmethod
    def _placed(rows: DataFrame, c: np.ndarray, n: int, name: str) -> DataFrame:
        """``rows`` with the n nearest cells, one as a number, more as an array."""
        kind = T.IntegerType() if n == 1 and name == "cell" else T.ArrayType(T.IntegerType())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = _nearest_cells(matrix(b.column("embedding")), c, n) if b.num_rows else np.empty((0, n), np.int32)
                cells = pa.array(near[:, 0]) if name == "cell" else pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, n, dtype=np.int32)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, cells], [*b.schema.names, name])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, kind)]))

    def build(self, vectors: DataFrame, cells: int | None = None, recall: float = 0.97, sample: int = SAMPLE, questions: int = 200, k: int = 5) -> dict[str, object]:
        """Sorts ``vectors`` (article_id, embedding; the last of a repeated id can't be told, so ids must be unique) into ``cells``.

        Vectors that can't be compared, and those of another length than most have, aren't stored. Without ``cells`` there are about as many as the
        root of the number of vectors. At most ``sample`` vectors come to the driver, those with the least hashes of their ids;
        the first ``questions`` of them are searched in all vectors to measure how many cells reach ``recall`` of their k nearest.
        """
        own = usable(vectors.select(F.col("article_id").cast("long").alias("article_id"), F.col("embedding").cast("array<float>").alias("embedding")))
        sizes = own.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
        if sizes is None:
            raise ValueError("there is no vector to sort")
        own = usable(own, sizes["size"])
        some = own.orderBy(F.xxhash64("article_id"), "article_id").limit(sample).collect()
        x = _unit(np.array([r["embedding"] for r in some], float))
        n = min(len(some), cells or max(1, round(sizes["n"] ** 0.5)))
        c = centroids_of(x, n)
        version = self.about().get("version", 0) + 1
        self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v{version}/centroids")
        table = self._rows(version)
        Folder(self.spark, f"{self.path}/v{version}").drop("cells")
        table.append(self._placed(own, c, 1, "cell"), checked=False)
        # where the exact neighbours of some questions are
        asked = self.spark.createDataFrame([(i, r["embedding"]) for i, r in enumerate(some[:questions])], "question_id long, embedding array<float>")
        hits = nearest(table.read(), asked, k).select("question_id", "article_id").join(table.read().select("article_id", "cell"), "article_id").collect()
        place = np.argsort(_nearest_cells(x[:questions], c, n), axis=1)
        needed = np.sort([place[r["question_id"], r["cell"]] + 1 for r in hits])
        probes = int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)])
        about = {"version": version, "size": sizes["size"], "cells": n, "probes": probes, "recall": float((needed <= probes).mean())}
        self._here.replace("CURRENT", about)
        self._here.drop(f"v{version - 2}")
        return about

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
        """question_id, article_id, distance and rank of the k nearest vectors among those in the ``probes`` nearest cells of each query.

        ``queries``: question_id, embedding; those that can't be compared, or are of another length, find nothing. They are written once with their
        cells; Spark then reads the folders of these cells alone. Cells with many vectors or many queries are dealt into blocks.
        """
        about, c = self.about(), self.centroids()
        probes = min(len(c), about["probes"] if probes is None else probes)
        at = f"{work_dir(self.spark)}-asked"
        own = usable(queries.select(F.col("question_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")), about["size"])
        self._placed(own, c, probes, "cells").write.parquet(at)
        asked = self.spark.read.parquet(at).select("id", "embedding", F.explode("cells").alias("cell"))
        # a row per cell, on both sides
        blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("_q")).collect()
        wanted = {r["cell"]: r["_q"] for r in blocks}
        rows = self.rows().filter(F.col("part").isin(sorted(wanted)))
        there = {r["part"]: r["_c"] for r in rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CORPUS_BLOCK).cast("int").alias("_c")).collect()}
        many = F.broadcast(self.spark.createDataFrame([(i, q, there[i]) for i, q in wanted.items() if i in there], "cell int, _q int, _c int"))
        left = asked.join(many, "cell").select("id", "embedding", "cell", _block(F.col("_q")).alias("q"), _all_of(F.col("_c")).alias("c"))
        right = rows.select(F.col("article_id").alias("id"), "embedding", F.col("part").alias("cell")).join(many, "cell").select("id", "embedding", "cell", _all_of(F.col("_q")).alias("q"), _block(F.col("_c")).alias("c"))
        return best_of(left, right, ["cell", "q", "c"], k)

    def upsert(self, new: DataFrame) -> int:
        """Vectors take the place of those with the same ids; only the cells that they leave or go to are written. ``new`` is a written table."""
        about = self.about()
        at = f"{work_dir(self.spark)}-placed"
        own = usable(new.select(F.col("article_id").cast("long").alias("article_id"), F.col("embedding").cast("array<float>").alias("embedding")), about["size"])
        self._placed(own, self.centroids(), 1, "cell").write.parquet(at)
        placed = self.spark.read.parquet(at)
        # a vector that can no longer be compared goes as well
        keys = placed.select("article_id", "cell").unionByName(new.select(F.col("article_id").cast("long").alias("article_id")).withColumn("cell", F.lit(None).cast("int")))
        self._rows(about["version"]).change(keys, lambda old: old.join(new.select("article_id"), "article_id", "left_anti").unionByName(placed), columns=[])
        return placed.count()

    def delete(self, ids: DataFrame) -> int:
        return self._rows(self.about()["version"]).delete(ids.select(F.col("article_id").cast("long").alias("article_id")))
