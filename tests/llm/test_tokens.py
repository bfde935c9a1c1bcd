from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter
from unittest.mock import MagicMock

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkwell.llm import packing
from sparkwell.llm.bpe import vocabulary
from sparkwell.llm.bpe_codec import Codec, decode, encode, round_trip
from sparkwell.llm.packing import pack_documents, plan, sequences
from sparkwell.llm.token_counts import Counter as TokenCounter
from sparkwell.llm.token_counts import token_counts
from sparkwell.llm.word_encoder import WordEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t.'|<>-0123456789abcdefghijklmnopqrstuvwxyzABCÉéß日本  ́İσς"), st.characters(exclude_categories=["Cs"])), max_size=80)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


def test_later_merges_use_merged_symbols():
    v = vocabulary(BYTES)
    made = {new: rank for rank, new in v.pair_rank.values()}
    assert all(made.get(a, -1) < rank and made.get(b, -1) < rank for (a, b), (rank, _) in v.pair_rank.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXT, st.just("x<|endoftext|>  y"), st.just("aaaaaaaab" * 9)), max_size=5))
def test_byte_bpe_is_the_library(byte_library, texts):
    raw = [t.encode() for t in texts]
    ids = [byte_library.encode(t, add_special_tokens=False).ids for t in texts]
    codec = Codec(vocabulary(BYTES), memo_words=50)
    encoded = codec.encode(raw)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoded] == ids
    assert [codec.decode(x).decode() for x in encoded] == [byte_library.decode(i, skip_special_tokens=False) for i in ids]
    assert TokenCounter(vocabulary(BYTES), memo_words=50).counts(raw) == [len(i) for i in ids]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXT, st.just("x<|endoftext|>Y <|ENDOFTEXT|>")), max_size=5))
def test_word_encoder_is_the_library(word_library, texts):
    got = WordEncoder(WORDS, memo_words=50).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [word_library.encode(t, add_special_tokens=False).ids for t in texts]


def test_queries_on_odd_documents(spark, odd_docs, no_docs, byte_library):
    texts = sorted((r.text or "" for r in odd_docs.collect()))
    counts, trips = token_counts(odd_docs, BYTES, 1024).collect(), round_trip(odd_docs, BYTES).collect()
    ids = [byte_library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in counts) == sorted((len(t.encode()), len(i), len(i) > 1024) for t, i in zip(texts, ids, strict=True))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in trips) == sorted((len(i), sha(np.array(i, "<u4").tobytes()), sha(t.encode())) for t, i in zip(texts, ids, strict=True))
    assert sorted(r.text for r in decode(encode(odd_docs, BYTES), BYTES).collect()) == texts
    assert token_counts(no_docs, BYTES, 1).count() == 0 and round_trip(no_docs, BYTES).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plans_use_every_piece_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([5, 10, 64, 4096])
    counts = Counter(rnd.randint(1, capacity) for _ in range(rnd.choice([0, 1, 50, 2000])))
    if counts:
        counts[rnd.choice(list(counts))] += 10**6 * (seed % 2)
    patterns = plan(dict(counts), capacity)
    used: Counter = Counter()
    for pattern, n in patterns:
        assert sum(x * times for x, times in pattern) <= capacity
        for x, times in pattern:
            used[x] += times * n
    assert used == +counts


def test_exact_complements_come_first():
    assert sorted(plan({6: 1, 4: 1, 5: 1, 3: 1, 2: 1, 7: 1, 1: 3}, 10)) == sorted([(((7, 1), (3, 1)), 1), (((6, 1), (4, 1)), 1), (((5, 1), (2, 1), (1, 3)), 1)])


def test_packing_holds_little_at_once(spark, monkeypatch):
    """A batch of many long texts is encoded in small slices, with the same pieces."""
    docs, task = MagicMock(), MagicMock()
    task.get().partitionId.return_value = 0
    monkeypatch.setattr(packing, "TaskContext", task)
    packing.token_pieces(docs, WORDS, 4096, 1)
    run = docs.select().mapInArrow.call_args[0][0]
    text = b"one two three four five six seven eight nine ten. " * 800
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([text] * 200, pa.binary())], ["doc_id", "data"])
    list(run(iter([batch.slice(0, 1)])))  # the encoder itself
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 200 * -(-(800 * 11 + 1) // 4096) and most < 40e6


def test_packing_odd_documents(odd_docs, no_docs, word_library):
    packed = pack_documents(odd_docs, WORDS, 4096, 1, with_ids=True).persist()
    rows = packed.toPandas()
    whole = [b"".join(g.sort_values("piece").ids) for _, g in rows[rows.doc_id.notna() & (rows.doc_id != 4)].groupby("doc_id")]
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect() if r.doc_id is not None and r.doc_id != 4}
    assert [np.frombuffer(x, "<u4").tolist() for x in whole] == [[*word_library.encode(texts[i], add_special_tokens=False).ids, 1] for i in sorted(texts)]
    assert len(rows) == len(odd_docs.collect()) + sum((len(x) // 4 - 1) // 4096 for x in whole)
    assert (rows.ids.map(zlib.crc32) == rows.ids_crc32).all() and (rows.ids.map(len) == 4 * rows.length).all()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 4096) + 1
    assert sorted(len(bytes(r.ids)) // 4 for r in sequences(packed).collect()) == sorted(rows.groupby("sequence_id").length.sum())
    assert pack_documents(no_docs, WORDS).count() == 0
