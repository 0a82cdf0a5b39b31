"""Operators 2 and 10, and the pipeline."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from pathweave.llm import fingerprints, queries, warc
from pathweave.llm.queries import op2_warc_index, op10_fingerprints

from .conftest import ROWS
from conftest import same_rows


def test_warc_query(spark, sf, duck):
    assert same_rows(op2_warc_index(spark, sf).toPandas(), duck.sql(queries.OP2_SQL).df())


BIG = "<html>" + "é" * 600 + "</html>"
PAGES = [
    (1, "http://A.Example.com:80/x?q=1 2", BIG), (2, "http://b.example.com/", BIG), (3, None, BIG), (4, "http://b.example.com/", None), (5, "not a url\nat all", ""), (None, "http://c.org", BIG), (None, None, None),
    (6, "http://dup.org/", "short"), (6, "http://dup.org/", "short"), (7, "http://[bad", "y" * 2000), (8, "http://é.example/ü", "short"),
]


def test_warc_on_odd_rows(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'k' AS key", "1 AS bytes", "2 AS root", "3 AS digest")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(PAGES)
    size = lambda h: len((h or "").encode())
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(p, size(h), sha(h), "revisit" if h == BIG and p in (1, 2) else "response", 3 if h == BIG and p in (1, 2) else None) for p, _, h in PAGES]
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=key) == sorted(want, key=key)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_index_finds_urls(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)  # many blocks
    table = spark.read.parquet(f"{sf}/pages.parquet")
    rows = table.collect()
    index = warc.CaptureIndex(table)
    assert len(index.search.first) >= len(rows) // 4
    for r in rows[::7]:
        found = index.find(r["url"])
        assert r["page_id"] in [x.page_id for x in found]
        assert {warc.url_key(x.url) for x in found} == {warc.url_key(r["url"])}
        own = next(x for x in found if x.page_id == r["page_id"])
        assert own.kind == "revisit" or own.payload == (r["html"] or "").encode()
    assert index.find("http://no.such.host/") == []
    some = index.lookup(table.where("page_id % 20 = 0")).collect()
    assert sorted(r["page_id"] for r in some) == [r["page_id"] for r in rows if r["page_id"] % 20 == 0]


def test_record_round_trip_and_damage():
    member = warc.record(5, "http://x.org/a b", b"payload", 7, hashlib.sha1(b"payload").hexdigest(), None)
    got = warc.parse(member)
    assert (got.page_id, got.kind, got.payload, got.refers_to) == (5, "response", b"payload", None)
    wrong = warc.record(5, None, b"payload", 7, hashlib.sha1(b"other").hexdigest(), None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(wrong)
    assert warc.url_key("https://WWW.Example.com:443/A/b?c=d#e") == "com,example,www)/A/b?c=d"


# -- fingerprints -------------------------------------------------------------------------------------------


def expected(rows):
    """doc_id, n_chars and edited_sha256 in order of ids, nulls first, ties by text."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, text) in enumerate(order):
        follower = order[(k + 1) % len(order)][1]
        out.append((i, len(text), hashlib.sha256(fingerprints.edited(text, follower).encode()).hexdigest()))
    return out


def test_fingerprints_query(spark, sf, texts):
    got = op10_fingerprints(spark, sf).toPandas().sort_values("doc_id")
    assert list(zip(got.doc_id, got.n_chars, got.edited_sha256, strict=True)) == expected(texts.items())
    by_text = {}
    for i, f in zip(got.doc_id, got.fingerprint, strict=True):
        assert by_text.setdefault(texts[i], f) == f
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    long = got[got.n_chars > 400]
    assert (long.near_edited > long.near_next + 0.2).mean() > 0.97


def test_fingerprints_in_many_ranges(spark, odd, none):
    for per_part in (1, 3, 1000):
        got = fingerprints.with_followers(odd, per_part).collect()
        rows = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr)
        assert rows == sorted(expected([(i, t) for i, t, *_ in ROWS]), key=repr)
    assert fingerprints.with_followers(none).count() == 0
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(odd).collect()}
    assert prints[2] == prints[3] == "" and prints[1] == prints[8] and prints[6] == prints[7] != prints[1]


@pytest.mark.parametrize("per_part", [None, 7, 50])
def test_an_id_with_many_texts_is_dealt_out(spark, per_part):
    """A third of all rows share an id, some of them a text too; each is followed by the next text."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcé "), rng.integers(0, 40)))
    rows = [(int(i), word()) for i in rng.integers(-50, 50, 200)] + [(5, word()) for _ in range(80)] + [(5, "same text")] * 20 + [(None, word()) for _ in range(9)]
    got = fingerprints.with_followers(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), per_part).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == sorted(expected(rows), key=repr)


def test_likeness_to_the_edited_and_the_next_text(spark, sf, texts):
    got = {r["doc_id"]: r for r in op10_fingerprints(spark, sf).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        text, follower = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        own, changed, after = (fingerprints.sketch(t.encode()) for t in (text, fingerprints.edited(text, follower), follower))
        assert got[i]["fingerprint"] == fingerprints.to_text(own) and got[i]["edited_fingerprint"] == fingerprints.to_text(changed)
        assert got[i]["near_edited"] == pytest.approx(fingerprints.likeness(own, changed))
        assert got[i]["near_next"] == pytest.approx(fingerprints.likeness(own, after))


def test_syncmers_are_context_free_and_cover():
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, 3000, dtype=np.uint8))
    h, at = fingerprints.syncmers(text)
    inner, inner_at = fingerprints.syncmers(text[500:2500])
    assert set(zip(inner.tolist(), (inner_at + 500).tolist(), strict=True)) == {(x, p) for x, p in zip(h.tolist(), at.tolist(), strict=True) if 500 <= p <= 2500 - fingerprints.K}
    for p in at[:50].tolist():  # each is closed: its least inner substring is at an edge
        others, _ = fingerprints.syncmers(text[p : p + fingerprints.K])
        assert len(others) == 1
    assert np.diff(at).max() <= fingerprints.K - fingerprints.S


def test_likeness():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefghij "), 5000))
    other = "".join(rng.choice(list("abcdefghij "), 5000))
    own = fingerprints.sketch(text.encode())
    assert fingerprints.likeness(own, own) == 1
    assert fingerprints.likeness(own, fingerprints.sketch(other.encode())) < 0.05
    assert fingerprints.likeness(own, fingerprints.sketch(("insertion " * 9 + text).encode())) > 0.85
    halves = fingerprints.sketch((text[:2500] + other[2500:]).encode())
    assert fingerprints.likeness(own, halves) == pytest.approx(1 / 3, abs=0.15)
    empty = fingerprints.sketch(b"")
    assert (fingerprints.likeness(empty, empty), fingerprints.likeness(own, empty)) == (1, 0)
    assert (fingerprints.from_text(fingerprints.to_text(own)) == own).all()


# -- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline(spark, sf, texts, tmp_path):
    """Each stage, written and read again, is held against what it must do on its own input."""
    from .test_codec_and_packing import SINGLE, check_packing
    from .test_duplicates import groups, with_repeats

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, now, read = docs.columns, dict(texts), docs
    mark = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, read, sf)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        read = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"]: r["text"] for r in read.collect()}
        if name in ("language_id", "quality_classifier", "near_dedup"):
            assert all(now[i] == t for i, t in after.items())
        if name == "language_id":
            assert len(after) >= 0.99 * len(now)
        if name == "quality_classifier":
            bad = [i for i in now if mark.get(i) == 0]
            good = [i for i in now if mark.get(i) == 1]
            assert sum(i in after for i in good) >= 0.97 * len(good)
            assert sum(i in after for i in bad) <= 0.3 * len(bad) + 1
        if name == "near_dedup":
            assert set(after) == {i for i, (_, c) in groups(now, 5).items() if i == c}
        if name == "substring_dedup":
            assert set(after) <= set(now)
            assert not with_repeats(after)
            clean = set(now) - with_repeats(now)
            assert all(after[i] == now[i] for i in clean)
        now = after
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(SINGLE)
    rows = corpus_pipeline.STAGES[-1][1](spark, read, sf).collect()
    assert check_packing(rows, now, lambda x: t.encode(x, add_special_tokens=False).ids) < 0.05
    assert corpus_pipeline.run(spark, sf).count() == len(rows)


def test_pipeline_on_odd_rows(spark, odd, none, sf, tmp_path):
    for table in (odd, none):
        read = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            read = stage(spark, read, sf)
            assert read.columns == odd.columns
            path = str(tmp_path / f"{id(read)}")
            read.write.parquet(path)
            read = spark.read.parquet(path)
            assert {(r["score"], r["node"], r["cuts"]) for r in read.collect()} <= {(1, "x", 8)}
        corpus_pipeline.STAGES[-1][1](spark, read, sf).count()
