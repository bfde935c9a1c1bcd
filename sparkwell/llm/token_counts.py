"""Token counts by heap-and-linked-list byte-pair merging; no ids are made."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import ByteVocabulary, chunks, units, vocabulary
from .common import Memo, doc_bytes, slices

#: Words that a worker remembers; about 100 bytes each.
MEMO_WORDS = 400_000


def count_merged(symbols: list[int], pair_rank: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols left after all merges: the adjacent pair of lowest rank (then leftmost) is popped again and again."""
    left = len(symbols)
    if left < 2:
        return left
    heap = [(*found, i) for i in range(left - 1) if (found := pair_rank.get((symbols[i], symbols[i + 1])))]
    if not heap:
        return left
    heap = [(rank, i, new, symbols[i], symbols[i + 1]) for rank, new, i in heap]
    heapify(heap)
    end = left
    after = list(range(1, end + 1))
    before = list(range(-1, end - 1))
    while heap:
        _, i, new, a, b = heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= end or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = new, -1
        after[i] = k = after[j]
        if k < end:
            before[k] = i
            if found := pair_rank.get((new, symbols[k])):
                heappush(heap, (found[0], i, found[1], new, symbols[k]))
        if (h := before[i]) >= 0 and (found := pair_rank.get((symbols[h], new))):
            heappush(heap, (found[0], h, found[1], symbols[h], new))
        left -= 1
    return left


class Counter:
    """Counts texts' tokens; chunks and units that came before are looked up."""

    def __init__(self, vocab: ByteVocabulary, memo_words: int = MEMO_WORDS) -> None:
        self.vocab, self.by_chunk, self.by_unit = vocab, Memo(memo_words), Memo(memo_words)

    def _units(self, words: list[str]) -> list[int]:
        ids, ranks = self.vocab.byte_id.tolist(), self.vocab.pair_rank
        return [count_merged([ids[b] for b in w.encode()], ranks) for w in words]

    def _chunks(self, missing: list[bytes]) -> list[int]:
        split = [units(c.decode()) for c in missing]
        self.by_unit.learn(set().union(*split), self._units)
        count = self.by_unit.__getitem__
        return [sum(map(count, x)) for x in split]

    def counts(self, texts: list[bytes]) -> list[int]:
        parts = [self.vocab.parts(x) for x in texts]
        split = [[c for p in x[::2] for c in chunks(p)] if len(x) > 1 else chunks(x[0]) for x in parts]
        self.by_chunk.learn(set().union(*split), self._chunks)
        count = self.by_chunk.__getitem__
        return [sum(map(count, x)) + len(p) // 2 for x, p in zip(split, parts, strict=True)]


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every text.

    Tokens are those of the byte-level BPE file without added tokens; its special strings inside texts are one token
    each. Null and empty texts have no bytes and no tokens. Repeated rows and null ids are counted like any others, an
    empty table gives no rows, other columns of ``docs`` are not read. Words of any length take n log n time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(tokenizer_path) or _counters.setdefault(tokenizer_path, Counter(vocabulary(tokenizer_path)))
        for b in slices(batches):
            texts = b.column("data").to_pylist()
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return doc_bytes(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
