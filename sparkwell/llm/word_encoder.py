"""Ids of a word-level BPE file by the tokenizers library, with words that came before looked up."""

from __future__ import annotations

import json
import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import Memo

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Words that a worker remembers; about 150 bytes each.
MEMO_WORDS = 300_000
#: Unknown words that are encoded as one text.
JOINED = 1_000
#: Letters that are whole characters and have one lower case of their own, then ASCII punctuation (no apostrophe): the library
#: splits between the two, and its normal form of the letters is their lower case.
_letters = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿа-яА-ЯёЁ]+").fullmatch
_MARKS = string.punctuation.replace("'", "")
#: Stands between other words; words that hold it are encoded alone.
_MARK = "\x01"


class WordEncoder:
    """For files that drop white space and never join across it, so that words can be encoded alone."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the same model without the steps that change nothing on lower-case letters
        spaces, spec["pre_tokenizer"] = {"type": "WhitespaceSplit"}, spec["pre_tokenizer"]
        bytes_ = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel"]
        self.letters = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [spaces, *bytes_]}}))
        self.letters.no_truncation()
        self.letters.no_padding()
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(1 + max(tokens.values()), bool)
        for token, i in tokens.items():
            self.ends[i] = token.endswith("</w>")
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.by_word, self.by_stem, self.by_tail = Memo(memo_words), Memo(memo_words), Memo(memo_words)

    def _joined(self, words: list[str], tokenizer: Tokenizer, between: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([between.join(words)], add_special_tokens=False)[0].ids, "<u4")

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Each ends with one marked token."""
        out: list[bytes] = []
        for at in range(0, len(stems), JOINED):
            ids = self._joined(stems[at : at + JOINED], self.letters, " ")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            out += [data[i:j] for i, j in zip([0, *cut], cut, strict=False)]
        return out

    def _others(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), JOINED):
            own = words[at : at + JOINED]
            ids = self._joined(own, self.tokenizer, f" {_MARK} ")
            cut = 4 * np.flatnonzero(ids == self.mark[0])
            if len(self.mark) == 1 and len(cut) == len(own) - 1:
                data = ids.tobytes()
                out += [data[i:j] for i, j in zip([0, *(cut + 4).tolist()], [*cut.tolist(), len(data)], strict=True)]
            else:
                out += [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
        return out

    def _words(self, missing: list[str]) -> list[bytes]:
        stems = [w.rstrip(_MARKS) for w in missing]
        tails = [w[len(x) :] for w, x in zip(missing, stems, strict=True)]
        plain = [x.isalpha() if x.isascii() else bool(_letters(x)) for x in stems]
        stems = [x.lower() for x in stems]
        self.by_stem.learn({x for x, p in zip(stems, plain, strict=True) if p}, self._stems)
        self.by_tail.learn({x for x, p in zip(tails, plain, strict=True) if p}, self._others)
        others = iter(self._others([w for w, p in zip(missing, plain, strict=True) if not p]))
        stem, tail = self.by_stem, self.by_tail
        return [stem[x] + tail[y] if p else next(others) for x, y, p in zip(stems, tails, plain, strict=True)]

    def flat(self, data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (binary, UTF-8) in one array, and where each text's begin and the last one's end.

        Equal words of a batch are solved once; the rest is done on whole arrays.
        """
        text = data.cast(pa.string())
        # lower case is what the file asks for, and fewer words are then to be solved; special strings are matched and letters are
        # joined with marks before that, so such texts keep theirs
        as_is = pc.or_(pc.match_substring(text, "<|"), pc.match_substring_regex(text, "[\\x{300}-\\x{36F}]"))
        words = pc.ascii_split_whitespace(pc.if_else(as_is, text, pc.ascii_lower(text)))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.by_word.learn(set(distinct), self._words)
        solved = list(map(self.by_word.__getitem__, distinct))
        size = np.fromiter(map(len, solved), np.int32, len(solved)) // np.int32(4)
        ids = np.frombuffer(b"".join(solved), "<u4")
        at = coded.indices.to_numpy()
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])
        del text, as_is, words, coded, distinct, solved
        # a batch's bytes are counted in 32 bits, and so are its ids: half the memory of the arrays below
        n = size[at]
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)])
        begin = (np.cumsum(size, dtype=np.int32) - size)[at]
        begin -= ends[:-1]
        place = np.repeat(begin, n)
        place += np.arange(ends[-1], dtype=np.int32)
        return ids[place], ends[edges].astype(np.int64)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, edges = self.flat(pa.array(texts, pa.binary()))
        return [ids[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)]
