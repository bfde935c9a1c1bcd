"""BPE encoding and decoding: merge rounds over the symbols of many words in one flat array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import ByteVocabulary, chunks, units, vocabulary
from .common import Memo, doc_bytes, slices

#: Words that a worker remembers; about 150 bytes each.
MEMO_WORDS = 300_000
NONE = np.iinfo(np.int64).max


def merge_rounds(words: list[bytes], vocab: ByteVocabulary) -> list[np.ndarray]:
    """The ids of each word.

    A round looks up the pairs of all open words at once by binary search over the sorted pair keys, takes each word's
    lowest rank and merges that pair wherever it stands in the word, from the left. A word is closed when none of its pairs
    can be merged. A pair that holds a merged symbol always ranks behind the merge that made it, so the order of merges is
    that of one-by-one merging.
    """
    done: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
    sizes = np.array([len(w) for w in words], np.int64)
    open_ = np.flatnonzero(sizes)
    symbols = vocab.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(open_, sizes[open_])
    last = len(vocab.pair_keys) - 1
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        keys = (symbols[:-1] << 32) | symbols[1:]
        at = np.minimum(np.searchsorted(vocab.pair_keys, keys), last)
        rank = np.where((vocab.pair_keys[at] == keys) & (owner[1:] == owner[:-1]), vocab.pair_ranks[at], NONE)
        rank = np.append(rank, NONE)
        lowest = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.append(starts, len(symbols)))
        closed = lowest == NONE
        for k in np.flatnonzero(closed):
            done[owner[starts[k]]] = symbols[starts[k] : starts[k] + lengths[k]].copy()
        least = np.repeat(lowest, lengths)
        pick = (rank == least) & (rank != NONE)
        # of pairs that overlap (as in "aaa"), every second one counts, from the left
        where = np.flatnonzero(pick)
        if len(where):
            head = np.r_[True, (where[1:] != where[:-1] + 1) | (rank[where[1:]] != rank[where[:-1]])]
            run = np.maximum.accumulate(np.where(head, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            symbols[where] = vocab.merged_id[rank[where]]
        keep = np.repeat(~closed, lengths)
        keep[where + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return done


class Codec:
    def __init__(self, vocab: ByteVocabulary, memo_words: int = MEMO_WORDS) -> None:
        self.vocab, self.by_chunk, self.by_unit = vocab, Memo(memo_words), Memo(memo_words)

    def _units(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        return [x.astype("<u4").tobytes() for k in range(0, len(raw), 20_000) for x in merge_rounds(raw[k : k + 20_000], self.vocab)]

    def _chunks(self, missing: list[bytes]) -> list[bytes]:
        split = [units(c.decode()) for c in missing]
        self.by_unit.learn(set().union(*split), self._units)
        ids = self.by_unit.__getitem__
        return [b"".join(map(ids, x)) for x in split]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        parts = [self.vocab.parts(x) for x in texts]
        split = [[chunks(p) for p in x[::2]] for x in parts]
        self.by_chunk.learn({c for x in split for p in x for c in p}, self._chunks)
        ids = self.by_chunk.__getitem__
        out = []
        for p, x in zip(parts, split, strict=True):
            made = [b"".join(map(ids, c)) for c in x]
            for k, special in enumerate(p[1::2]):
                made[k] += self.vocab.special[special].to_bytes(4, "little")
            out.append(b"".join(made))
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8; ids that don't end in whole characters give the replacement character, as the library has it."""
        raw = b"".join(map(self.vocab.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode(errors="replace").encode()


_codecs: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    return _codecs.get(path) or _codecs.setdefault(path, Codec(vocabulary(path)))


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every text; null and empty texts have none.

    Repeated rows and null ids are kept as they are, an empty table gives no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_codec(tokenizer_path).encode(b.column("data").to_pylist()), pa.binary())], ["doc_id", "ids"])

    return doc_bytes(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text for the columns of :func:`encode`; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_codec(tokenizer_path).decode(x or b"").decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded again in one pass.

    Null and empty texts have no ids; their hashes are those of no bytes. Repeated rows and null ids are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer_path)
        for b in slices(batches):
            ids = codec.encode(b.column("data").to_pylist())
            sha = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_bytes(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
