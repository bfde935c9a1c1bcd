"""The vocabulary of a byte-level BPE file, and how texts fall into the units that its merges work on."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: the published split pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that is not ASCII could stand beside a chunk's white space and so belong to the same run.
_WIDE = regex.compile(r"[^\S\x00-\x7f]")
#: A run of white space with the word behind it. No unit crosses such a chunk's edges, so chunks can be solved alone.
_chunks = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+").findall
units = regex.compile(PATTERN).findall


class ByteVocabulary:
    """Ids of single bytes, merges with their ranks, each id's bytes, and the special strings of the file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}
        vocab = spec["model"]["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for char, b in byte_of.items():
            self.byte_id[b] = vocab[char]
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token
        self.pair_rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pair_rank.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        keys = np.array([(a << 32) | b for a, b in self.pair_rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.pair_rank.values()], np.int64)[order]
        self.merged_id = np.zeros(len(spec["model"]["merges"]), np.int64)
        for rank, new in self.pair_rank.values():
            self.merged_id[rank] = new
        self._split = re.compile(b"(" + b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + b")").split if self.special else None

    def parts(self, data: bytes) -> list[bytes]:
        """Ordinary text and special strings in turn; special strings stand at odd places."""
        return self._split(data) if self._split and any(s in data for s in self.special) else [data]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteVocabulary:
    """One per worker and file."""
    return ByteVocabulary(path)


def chunks(data: bytes) -> list[bytes]:
    found = _chunks(data)
    # ASCII text can't hold wide white space; the test for others is made on the text once.
    return found if data.isascii() or not _WIDE.search(data.decode()) else [data]
