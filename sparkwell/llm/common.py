"""What the operators of this subpackage share: work tables, text access, bounded memos."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a Java regular expression: the ASCII white space that ``bytes.split`` splits at.
SPACE = r"[\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a local session (tests) gets a temporary
    folder, any other the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, tempfile.mkdtemp(prefix="sparkwell-")) if local else spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


def save_table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: lineage is cut and the size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkwell-work/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_salted(rows: DataFrame, few: DataFrame, on: list[str], by: str, salts: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few`` (one row per key), where a key may have any share of ``rows``.

    Rows of a key are dealt by a hash of the column ``by``; ``few`` first meets the keys with the salts in use, which are
    at most ``salts`` rows per key. Rows with a null key match nothing.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    used = salted.select(*on, "_salt").distinct().join(few, on)
    return salted.join(used, [*on, "_salt"], how).drop("_salt")


def doc_bytes(docs: DataFrame, *more) -> DataFrame:
    """doc_id and the UTF-8 bytes of text (null: empty), and no other column of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"), *more)


def slices(batches: Iterable[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose ``data`` have about ``most`` bytes; one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("data")).to_pylist()
        start = total = 0
        for k, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def pieces(texts: list[bytes], most: int = 2_000_000) -> Iterator[list[bytes]]:
    """The texts in runs of about ``most`` bytes; one text at least."""
    start = total = 0
    for k, x in enumerate(texts):
        if total and total + len(x) > most:
            yield texts[start:k]
            start, total = k, 0
        total += len(x)
    if start < len(texts):
        yield texts[start:]


_kept: dict[object, object] = {}


def _give_back() -> None:
    """What is freed goes back to the system (of C's memory, where the library can do that)."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def kept(name: object, make: Callable[[], object]) -> object:
    """What a worker keeps between tasks under ``name``. What it kept under another name goes first, so that a worker that
    serves several operators in turn holds the memos of one of them."""
    if name not in _kept:
        _kept.clear()
        _give_back()
        _kept[name] = make()
    return _kept[name]


def keep_nothing(name: object) -> None:
    """For operators without memos of their own between tasks: what the worker kept for others goes."""
    kept(name, lambda: None)


class Memo(dict):
    """Solved words of a worker. It keeps ``limit`` words at most; when it is full, those of the current batch stay."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit = limit

    def learn(self, seen: set, solve: Callable[[list], Iterable]) -> None:
        """Afterwards every word of ``seen`` is a key."""
        missing = list(seen.difference(self))
        if len(self) + len(missing) > self.limit:
            stay = {w: self[w] for w in seen if w in self}
            self.clear()
            self.update(stay)
        if missing:
            self.update(zip(missing, solve(missing), strict=True))
