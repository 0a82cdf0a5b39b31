"""Operators 4 and 6: encoding against the public libraries, packing against its contract."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathweave.llm import bpe, packing
from pathweave.llm.queries import op4_packing, op6_bpe_codec

from .conftest import ROWS

MULTI, SINGLE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def json_reference():
    t = Tokenizer.from_file(SINGLE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def encode(path, texts):
    import pyarrow as pa

    ids, at = bpe.encoder(path).encode(pa.array(texts, pa.string()))
    return [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))]


def tricky(n=1500, seed=0):
    rng = random.Random(seed)
    signs = list("'''sstmdrvle  \n\t\r abAB19!?.,é你🙂½²ª_-#") + ["　", "\x85", " ", "​", "'ll", "'re", " '", "<|endoftext|>"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", " ", "x" * 3000, "!" * 2500 + "a", "ab" * 900, " \n " * 50, "\U0010ffff" * 5]


def test_encode_like_the_libraries(reference, json_reference):
    texts = tricky()
    assert encode(MULTI, texts) == [reference.encode_ordinary(t) for t in texts]
    assert encode(SINGLE, texts) == [json_reference(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(reference, text):
    (ids,) = encode(MULTI, [text])
    assert ids == reference.encode_ordinary(text)
    assert bpe.decode(np.array(ids, int), bpe.vocabulary(MULTI).tokens) == text.encode()


def test_scan_equals_single_steps():
    rng = np.random.default_rng(4)
    kinds = rng.integers(0, bpe._CLASSES, 3000).astype(np.uint8)
    kinds[1000:2000] = rng.choice([bpe._L, bpe._AP, bpe._R, bpe._E, bpe._N], 1000)  # blocks without white space
    state, want = bpe._FRESH, []
    for k in kinds.tolist():
        want.append(state)
        state = bpe._step(state, k)[0]
    assert bpe.states_before(kinds).tolist() == want


def test_small_cache_changes_nothing(reference):
    import pyarrow as pa

    coder = bpe.Encoder(bpe.vocabulary(MULTI), cache=50)
    for text in tricky(60, 9):
        ids, _ = coder.encode(pa.array([text]))
        assert ids.tolist() == reference.encode_ordinary(text)


def test_codec_query(spark, sf, texts, reference):
    got = {r["doc_id"]: r for r in op6_bpe_codec(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = reference.encode_ordinary(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_codec_on_odd_rows(odd, none, reference):
    rows = bpe.encode_decode(odd, MULTI, with_ids=True).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["ids"] == reference.encode_ordinary(r["text"] or "")
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode_decode(none, MULTI).count() == 0


def check_packing(rows, texts, encode_one, capacity=1024):
    """Every id in one piece, crc32s right, sequences gapless and within the capacity; the padding's share."""
    ids = {i: np.array([*encode_one(t or ""), 0], "<u4") for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for spans, total in [(sorted(s), len(ids[i])) for i, s in by_doc.items()] + [(sorted(s), None) for s in by_sequence.values()]:
        at = 0
        for start, length in spans:
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at <= capacity
    return 1 - sum(map(len, ids.values())) / (capacity * len(by_sequence))


def test_packing_query(spark, sf, texts, json_reference):
    assert check_packing(op4_packing(spark, sf).collect(), texts, json_reference) < 0.03


def test_packing_on_odd_rows(odd, none, json_reference):
    rows = packing.pack(odd, SINGLE).collect()
    single = {i: t for i, t, *_ in ROWS if i is not None}
    repeated = [r for r in rows if r["doc_id"] == 8]
    assert len(repeated) == 2 and len({(r["sequence_id"], r["offset"]) for r in repeated}) == 2
    assert len([r for r in rows if r["doc_id"] is None]) == 2
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert {r["doc_id"] for r in rows} - {None} == set(single)
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [1]
    assert packing.pack(none, SINGLE).count() == 0


def test_knapsack():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = np.unique(rng.integers(1, 15, 4))
        prices = rng.random(len(sizes))
        value, counts = packing.knapsack(sizes, prices, 20)
        best = np.zeros(21)
        for c in range(1, 21):
            best[c] = max([best[c - 1], *(best[c - s] + p for s, p in zip(sizes, prices, strict=True) if s <= c)])
        assert value == pytest.approx(best[20]) == pytest.approx((counts * prices).sum())
        assert (counts * sizes).sum() <= 20


def test_plan_places_everything_once():
    rng = np.random.default_rng(6)
    for histogram in ({}, {128: 7}, {1: 1}, {127: 5, 1: 5}, {int(k): int(v) for k, v in zip(rng.permutation(128)[:60] + 1, rng.integers(1, 90, 60), strict=True)}):
        spots = {}
        ranks = {k: set() for k in histogram}
        for length, first, end, sequence, per, slot in packing.plan(histogram, 128):
            for r in range(first, end):
                assert r not in ranks[length]
                ranks[length].add(r)
                spots.setdefault(sequence + (r - first) // per, []).append((slot + (r - first) % per, length))
        assert {k: len(v) for k, v in ranks.items()} == histogram
        for inside in spots.values():
            assert sorted(s for s, _ in inside) == list(range(len(inside)))
            assert sum(n for _, n in inside) <= 128


def thue_morse(n):
    """A word over a and b, and its complement: equal hashes in every base modulo a power of two."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return [word, word.translate(str.maketrans("ab", "ba"))]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_pieces_that_weak_hashes_mix_up(reference, json_reference, n):
    texts = thue_morse(n)
    for path, want in ((MULTI, reference.encode_ordinary), (SINGLE, json_reference)):
        assert encode(path, texts) == [want(t) for t in texts]  # in one batch
        assert [encode(path, [t])[0] for t in texts] == [want(t) for t in texts]  # one after the other
        tokens = bpe.vocabulary(path).tokens
        assert [bpe.decode(np.array(i), tokens).decode() for i in encode(path, texts)] == texts


def test_equal_hashes_of_different_pieces(reference, monkeypatch):
    import pyarrow as pa

    real = bpe.span_hashes
    monkeypatch.setattr(bpe, "span_hashes", lambda *x: real(*x) % np.uint64(7))
    coder, texts = bpe.Encoder(bpe.vocabulary(MULTI)), tricky(200, 3)
    for _ in range(2):
        ids, at = coder.encode(pa.array(texts))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [reference.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("stretch", [1, 7, 300])
def test_long_texts_are_scanned_in_stretches(reference, monkeypatch, stretch):
    monkeypatch.setattr(bpe, "STRETCH", stretch)
    texts = tricky(60, 5)
    assert encode(MULTI, texts) == [reference.encode_ordinary(t) for t in texts]


def test_a_text_of_megabytes(reference):
    text = "Some wörds, it's 123 of them\n\n  and more🙂. " * 60_000
    (ids,) = encode(MULTI, [text])
    assert ids == reference.encode_ordinary(text)


def test_span_hashes_are_of_the_bytes_alone():
    from pathweave.llm.common import span_hashes

    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 60_000, dtype=np.uint8)
    starts = rng.integers(0, 59_000, 4000)
    ends = starts + rng.integers(1, 12, 4000)
    kinds = {}
    for h, a, b in zip(span_hashes(buf, starts, ends).tolist(), starts.tolist(), ends.tolist(), strict=True):
        kinds.setdefault(buf[a:b].tobytes(), set()).add(h)
    assert all(len(hashes) == 1 for hashes in kinds.values())
    assert len({h for hashes in kinds.values() for h in hashes}) == len(kinds)
