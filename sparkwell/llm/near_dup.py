"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bytes, join_salted, kept, save_table, slices
from .components import UnionFind, components
from .superminhash import Shingler, band_keys, mix, signatures

#: 51 bands of 5 of 256 values: a pair at the threshold of 0.75 meets in none of them once in a million.
SIZE, ROWS, BANDS = 256, 5, 51
#: Shingles and documents of a part of a star, about; the hub comes on top, and a document that is longer alone is a part.
UNIT_SHINGLES, UNIT_DOCUMENTS = 400_000, 1_000
#: Parts into which the rows of equal sets are dealt.
SALTS = 1_024


def _shingler() -> Shingler:
    return kept("shingles", Shingler)


def _fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return mix(shingles).sum(dtype=np.uint64).tobytes() + mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).tobytes()


def sketches(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes that stand for the set; null if it is empty), bands (array of keys) and binary columns ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2_000_000):
            sets = _shingler().sets(b.column("data").to_pylist())
            keys = band_keys(signatures(sets, SIZE), BANDS, ROWS)
            offsets = np.concatenate([[0], np.cumsum([BANDS if len(x) else 0 for x in sets])]).astype(np.int32)
            flat = keys[[len(x) > 0 for x in sets]].reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([_fingerprint(x) if len(x) else None for x in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())), *(b.column(c) for c in more)],
                ["doc_id", "n_shingles", "set_key", "bands", *more],
            )

    own = docs.select("doc_id", "text", *more)
    return doc_bytes(own, *more).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>" + "".join(f", {c} binary" for c in more))


def linked_within(ids: list, sets: list[np.ndarray], percent: int, found: UnionFind) -> None:
    """Joins all documents whose sets overlap enough, by counts over the postings of each set's shingles."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    heads = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    many = np.diff(np.append(heads, len(flat)))
    values = flat[heads]
    for k, own in enumerate(sets):
        at = np.searchsorted(values, own)
        at = at[many[at] > 1]
        n = many[at]
        if not len(n):
            continue
        where = np.repeat(heads[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[where], minlength=len(sets))
        for j in np.flatnonzero(100 * common >= percent * (sizes[k] + sizes - common)):
            if j > k:
                found.union(ids[k], ids[int(j)])


def _by_set(units: DataFrame) -> DataFrame:
    """node, doc_id, set_key and the units (hub, p, q, parts) to which a set goes."""
    # a set that goes to very many units does so by several rows
    own = units.groupBy("node", "doc_id", "set_key", F.floor(F.col("p") / 256).alias("_p"), F.floor(F.col("q") / 256).alias("_q")).agg(F.collect_list(F.struct("hub", "p", "q", "parts")).alias("units"))
    return save_table(own.drop("_p", "_q"), "units")


def _shingled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, doc_id, units and shingles (binary) of the sets of ``wanted``; large marks a row of each set that is in a star of several parts."""
    # the same way at every size: the ids in stars grow with the input
    texts = doc_bytes(docs).join(wanted.hint("merge"), "doc_id")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple] = set()  # rows that repeat a document come to the same task
        marked: set[int] = set()
        for b in slices(batches, 2_000_000):
            rows = []
            sets = _shingler().sets(b.column("data").to_pylist())
            for x, *own, units_ in zip(sets, *(b.column(c).to_pylist() for c in ("set_key", "node", "doc_id", "units")), strict=True):
                if len(x) and _fingerprint(x) == own[0]:  # else another text of the same doc_id
                    new = []
                    for u in units_:
                        if (key := (u["hub"], u["p"], u["q"], own[1])) not in done:
                            done.add(key)
                            new.append(u)
                    if new:
                        large = own[1] not in marked and any(u["parts"] > 1 for u in new)
                        if large:
                            marked.add(own[1])
                        rows.append((own[1], own[2], new, large, x.tobytes()))
            for at in range(0, len(rows), 1_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1_000], strict=True), kinds, strict=True)], names)

    unit = pa.struct([("hub", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("parts", pa.int32())])
    kinds = (pa.int64(), pa.int64(), pa.list_(unit), pa.bool_(), pa.binary())
    names = ["node", "doc_id", "units", "large", "shingles"]
    return texts.mapInArrow(shingle, "node long, doc_id long, units array<struct<hub: long, p: int, q: int, parts: int>>, large boolean, shingles binary")


def _compared(sets: DataFrame, percent: int) -> DataFrame:
    """Links of all pairs that a unit holds. ``sets``: node, doc_id, shingles and units.

    Rows with a and b (structs of doc_id and node) are a unit's links as a forest; rows with ``left`` name the nodes that links
    inside the unit don't connect with the hub, where the hub's star has several parts.
    """

    def verify(unit: pa.Table) -> pa.Table:
        sets = {(d, n): x for d, n, x in zip(*(unit.column(c).to_pylist() for c in ("doc_id", "node", "shingles")), strict=True)}
        found, nodes = UnionFind(), list(sets)
        linked_within(nodes, [np.frombuffer(x, np.uint64) for x in sets.values()], percent, found)
        links, hub = found.links(), unit.column("hub")[0].as_py()
        left: list[int] = []
        if unit.column("parts")[0].as_py() > 1:
            root = next((found.find(x) for x in nodes if x[1] == hub), None)
            left = [x[1] for x in nodes if found.find(x) != root]
        pair = lambda k: [{"doc_id": x[k][0], "node": x[k][1]} for x in links] + [None] * len(left)
        kind = pa.struct([("doc_id", pa.int64()), ("node", pa.int64())])
        n = len(links) + len(left)
        return pa.table({"a": pa.array(pair(0), kind), "b": pa.array(pair(1), kind), "hub": pa.array([hub] * n, pa.int64()), "left": pa.array([None] * len(links) + left, pa.int64())})

    node = "struct<doc_id: long, node: long>"
    dealt = sets.select("node", "doc_id", "shingles", F.explode("units").alias("u")).select("u.hub", "u.p", "u.q", "u.parts", "node", "doc_id", "shingles")
    return save_table(dealt.groupBy("hub", "p", "q").applyInArrow(verify, f"a {node}, b {node}, hub long, left long"), "compared")


def _grouped(docs: DataFrame, percent: int, *more: str) -> DataFrame:
    """doc_id, n_shingles, set_key and ``more`` of every row; for its set (if it has one and an id) root: doc_id and node of the least that links reach, and own: those of the set itself."""
    all_ = save_table(sketches(docs, *more), "sketches")
    some = all_.filter(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    # one row per set; what follows knows it by a number
    sets = some.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"))
    sets = save_table(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    banded = sets.select("node", "n_shingles", F.explode("bands").alias("key"))
    # aggregates and a plain join of written tables, so that Spark can pre-aggregate a frequent key and split its join
    buckets = save_table(banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("_last")).filter("hub < _last").select("key", "hub"), "buckets")
    stars = save_table(banded.join(buckets, "key").select("hub", "node", "n_shingles").distinct(), "stars")
    parts = F.ceil(F.greatest(F.sum("n_shingles") / UNIT_SHINGLES, F.count(F.lit(1)) / UNIT_DOCUMENTS)).cast("int").alias("parts")
    large = save_table(stars.groupBy("hub").agg(parts).filter("parts > 1"), "large")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    dealt = stars.join(large, "hub", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
    named = sets.select("node", "doc_id", "set_key")
    # the hub is in every part of its star
    to = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    units = dealt.select("hub", "node", "parts", F.explode(to).alias("p"), F.lit(0).alias("q"))
    # written, so that texts are dealt by id once, whatever follows
    shingled = save_table(_shingled(docs, _by_set(units.join(named, "node"))), "shingled")
    first = _compared(shingled, percent)
    links = first.filter("a is not null").select("a", "b")
    # what the hub doesn't reach inside its part meets all other parts, too
    left = save_table(first.filter("left is not null").select("hub", F.col("left").alias("node")).distinct(), "left")
    if not left.isEmpty():
        blocks = save_table(left.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / (UNIT_DOCUMENTS / 2)).cast("int").alias("blocks")), "blocks")
        block = F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int")
        one = left.join(blocks, "hub").join(large, "hub").select("hub", "node", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), block.alias("q"))
        other = dealt.join(blocks, "hub").select("hub", "node", "parts", F.col("own").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"))
        more_units = _by_set(one.unionByName(other).distinct().join(named, "node")).select("node", "units")
        # only the sets of such stars are dealt again
        again = shingled.filter("large").select("node", "doc_id", "shingles")
        second = _compared(again.join(more_units.hint("merge"), "node"), percent)
        links = links.unionByName(second.filter("a is not null").select("a", "b"))
    root = components(links).select(F.col("node.node").alias("node"), "root")
    me = F.struct("doc_id", "node")
    known = save_table(named.join(root, "node", "left").select("set_key", me.alias("own"), F.coalesce("root", me).alias("root")), "known")
    # a set may have any share of the rows
    found = join_salted(all_.drop("bands"), known, ["set_key"], "doc_id", SALTS, "left")
    there = F.col("doc_id").isNotNull()
    return found.select("doc_id", "n_shingles", "set_key", *more, F.when(there, F.col("own")).alias("own"), F.when(there, F.col("root")).alias("root"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents with at least ``percent`` of common among all distinct 5-word shingles are linked; component_id is the
    smallest doc_id that links reach, kept says whether that is the document itself.

    Equal sets count as one. Sets that share a band key form buckets; the buckets with the same least set, their hub, are a star.
    A star's sets are compared on their full shingles, in parts of bounded size that all hold the hub; only those that links
    inside a part don't connect with the hub are compared with the other parts as well. So groups of copies cost their number, and no
    pairs are ever rows. Links leave a unit as a forest.

    Null text, empty text and text without words: no shingles, linked with nothing. A null doc_id: component_id null,
    kept. Rows that repeat a doc_id with another text are grouped each by its own text. An empty table gives no rows.
    """
    found = _grouped(docs, percent)
    out = found.select("doc_id", "n_shingles", F.coalesce("root.doc_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each group, the one with the least id, with all columns of ``docs``; of rows that repeat it, one stays.

    Documents without id or without words are no copies of each other and stay. A text goes only if it is linked itself: one
    that shares its doc_id with a copy of something else stays.
    """
    of_text = F.unhex(F.md5(F.col("text")))
    found = _grouped(docs.select("doc_id", "text", of_text.alias("text_key")), percent, "text_key").filter("own is not null")
    # one text of each id and set
    texts = found.groupBy("doc_id", "text_key").agg(F.any_value("set_key").alias("set_key"), F.any_value(F.col("own.node") == F.col("root.node")).alias("ends"), F.any_value(F.col("root.doc_id")).alias("least"), F.count(F.lit(1)).alias("n"))
    texts = save_table(texts, "texts")
    first = texts.groupBy("doc_id", "set_key").agg(F.min("text_key").alias("text_key")).withColumn("first", F.lit(True))
    stays = F.col("ends") & (F.col("doc_id") == F.col("least")) & F.col("first").isNotNull()
    marked = save_table(texts.join(first, ["doc_id", "set_key", "text_key"], "left").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), stays.alias("__stays"), "n"), "kept")
    same = (docs["doc_id"].cast("long") == F.col("__id")) & (of_text == F.col("__key"))
    out = docs.join(marked.filter("not __stays or n > 1").select("__id", "__key"), same, "left_anti")
    again = marked.filter("__stays and n > 1").select("__id", "__key")
    if again.isEmpty():
        return out
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.join(again, same).select("__id", "__key", F.struct(*columns).alias("__row"))
    once = rows.groupBy("__id", "__key").agg(F.min_by("__row", F.xxhash64(F.to_json("__row"))).alias("__row"))
    return out.unionByName(once.select(*[F.col("__row")[c].alias(c) for c in docs.columns]))


SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
grams as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as g from d),
sets as (select distinct doc_id, g from grams),
sized as (select doc_id, count(*) as n from sets group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as c from sets x join sets y on x.g = y.g and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
links as (select a, b from common join sized s on s.doc_id = a join sized t on t.doc_id = b where 100 * c >= 75 * (s.n + t.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from d union select reach.doc_id, both_ways.b from reach join both_ways on reach.other = both_ways.a),
least as (select doc_id, min(other) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from least left join sized using (doc_id)
"""
