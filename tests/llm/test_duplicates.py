"""Operators 3, 5 and 7: near duplicates and repeated passages, against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from pathweave.llm import chunk_dedup, components, near_dedup, passages, suffix_dedup
from pathweave.llm.common import tune
from pathweave.llm.queries import op3_near_dedup, op5_chunk_dedup, op7_suffix_dedup

from .conftest import PASSAGE, ROWS, docs_of


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else frozenset([tuple(words)])


def groups(texts, width):
    """id → (set size, least reachable id), over all pairs."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_query(spark, sf, texts):
    want = groups(texts, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op3_near_dedup(spark, sf).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts)


def test_near_duplicates_on_odd_rows(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    one = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [one[i]["component_id"] for i in (1, 8, 6, 7)] == [1, 1, 6, 6]
    assert [one[i]["kept"] for i in (1, 8, 6, 7)] == [True, False, True, False]
    for i in (2, 3, 4):
        assert (one[i]["n_shingles"], one[i]["component_id"], one[i]["kept"]) == (0, i, True)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2
    assert near_dedup.near_duplicates(none).count() == 0


def near_copies(n, share, seed):
    """A base of 120 words and copies with some words replaced, all with each other around the threshold."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    return {i: " ".join(f"v{rng.randrange(10**6)}" if rng.random() < share else w for w in base) for i in range(n)}


def test_a_group_of_near_copies(spark, monkeypatch):
    texts = near_copies(150, 0.04, 1) | {1000 + i: t for i, t in near_copies(40, 0.08, 2).items()}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert got == groups(texts, 2)


def test_regions_over_the_limit_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 20)
    texts = near_copies(120, 0.05, 3)
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 2).collect()}
    want = {i: c for i, (_, c) in groups(texts, 2).items()}
    assert np.mean([got[i] == want[i] for i in want]) >= 0.95
    assert all(want[got[i]] == want[i] for i in want)  # no link is made up


def test_small_tiles_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 4)
    texts = near_copies(150, 0.06, 3) | {1000 + i: t for i, t in near_copies(60, 0.05, 4).items()}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert got == groups(texts, 2)


@pytest.mark.parametrize("share", [0.0, 0.7])
def test_nodes_of_different_parts_meet_in_a_tile(spark, monkeypatch, share):
    """Also when all values are equal: tiles look at the node alone."""
    monkeypatch.setattr(near_dedup, "REGION", 40)
    rng = random.Random(1)
    part = {i: 0 if rng.random() < share else i for i in range(1, 301)}
    rows = spark.createDataFrame([(7, i, p) for i, p in part.items()] + [(8, 1, 1), (8, 2, 1), (9, 1, 1), (9, 2, 2)], "region long, node long, part long")
    held = collections.defaultdict(set)
    for r in near_dedup.tiles(rows).collect():
        held[r["region"], r["block"]].add(r["node"])
    met = {(a, b) for (region, _), nodes in held.items() if region == 7 for a in nodes for b in nodes if a < b and part[a] != part[b]}
    assert met == {(a, b) for a in part for b in part if a < b and part[a] != part[b]}
    assert {region for region, _ in held} == {7, 9}
    assert max(map(len, held.values())) <= 80


@pytest.mark.parametrize("share", [0.0, 0.7])
def test_tiles_of_long_texts_have_fewer_nodes(spark, share):
    """300 nodes of 40,000 shingles: no tile holds more than some two million of them."""
    rng = random.Random(2)
    part = {i: 0 if rng.random() < share else i for i in range(1, 301)}
    rows = spark.createDataFrame([(7, i, p, 40_000) for i, p in part.items()] + [(8, i, i, 400) for i in range(300)], "region long, node long, part long, size long")
    held = collections.defaultdict(set)
    for r in near_dedup.tiles(rows).collect():
        held[r["region"], r["block"]].add(r["node"])
    met = {(a, b) for (region, _), nodes in held.items() if region == 7 for a in nodes for b in nodes if a < b and part[a] != part[b]}
    assert met == {(a, b) for a in part for b in part if a < b and part[a] != part[b]}
    assert max(len(nodes) for (region, _), nodes in held.items() if region == 7) * 40_000 <= 2 * near_dedup.REGION * near_dedup.PER_NODE
    assert [len(nodes) for (region, _), nodes in held.items() if region == 8] == [300]


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    tune(spark)
    texts = spark.range(600).repartition(1).selectExpr("id", "repeat('x', 100000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    got = texts.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 600 and max(r["bytes"] for r in got) <= 10_000_000


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    diffs = []
    for k in range(100, 1000, 60):
        a, b = pool[:1000], pool[k : 1000 + k]
        diffs.append((near_dedup.signature(a) == near_dedup.signature(b)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(diffs)) < 0.03 and np.abs(diffs).max() < 0.15


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (9, 8), (3, 1), (5, 5), (None, 4)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)]])
def test_components(spark, edges):
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


# -- repeated passages ------------------------------------------------------------------------------------


def with_repeats(texts, k=51):
    """Ids of texts that share k words in a row, byte for byte between words, with another text."""
    places = collections.defaultdict(set)
    for i, t in texts.items():
        words = (t or "").split()
        for j in range(len(words) - k + 1):
            places[tuple(words[j : j + k])].add(i)
    return {i for ids in places.values() if len(ids) > 1 for i in ids}


def check_spans(rows, texts):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    for r in rows:
        span = raw[r["doc_id"]][r["start"] : r["end"]]
        assert len(span.split()) == r["n_words"] >= 51
        if r["other_id"] is not None:
            assert raw[r["other_id"]][r["other_start"] :].startswith(span)
            assert (r["other_id"], r["other_start"]) < (r["doc_id"], r["start"])


@pytest.mark.parametrize("query", [op5_chunk_dedup, op7_suffix_dedup])
def test_passages_query(spark, sf, texts, query):
    rows = query(spark, sf).collect()
    check_spans(rows, texts)
    assert {r["doc_id"] for r in rows} == with_repeats(texts)


@pytest.mark.parametrize("operator", [chunk_dedup, suffix_dedup])
def test_passages_on_odd_rows(spark, odd, none, operator):
    rows = operator.repeated_passages(odd).collect()
    assert {r["doc_id"] for r in rows} == {6, 7, 11, 12}
    check_spans(rows, {i: t for i, t, *_ in ROWS if i is not None})
    assert {r["doc_id"]: r["n_words"] for r in rows if r["doc_id"] in (11, 12)} == {11: 60, 12: 60}
    cut = operator.without_repeats(odd)
    assert cut.columns == odd.columns
    left = sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=repr)
    want = [(i, {7: "", 12: "other start  other end"}.get(i, t)) for i, t, *_ in ROWS]
    assert left == sorted(want, key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["doc_id"] in (7, 12))
    assert operator.repeated_passages(none).count() == 0
    assert operator.without_repeats(none).count() == 0


@pytest.mark.parametrize("operator", [chunk_dedup, suffix_dedup])
def test_planted_passages(spark, operator):
    """Passages of 51 to 70 words anywhere in texts of random words, and shorter ones that are none."""
    rng = random.Random(8)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(n)]
    texts = {}
    long, short = set(), set()
    for k in range(40):
        n = rng.randint(51, 70) if k % 2 else rng.randint(20, 50)
        passage = words(n)
        for copy in range(3):
            i = 10 * k + copy
            texts[i] = " ".join([*words(rng.randint(0, 60)), *passage, *words(rng.randint(0, 60))])
            (long if k % 2 else short).add(i)
    docs = docs_of(spark, [(i, t, "en", "s", 1) for i, t in texts.items()])
    rows = operator.repeated_passages(docs).collect()
    check_spans(rows, texts)
    got = {r["doc_id"] for r in rows}
    assert not got & short
    assert got == long


def covered(rows, texts):
    """Numbers of the words of each text that are in a span."""
    out = collections.defaultdict(set)
    for r in rows:
        first = len(texts[r["doc_id"]].encode()[: r["start"]].split())
        out[r["doc_id"]].update(range(first, first + r["n_words"]))
    return dict(out)


def brute_cover(texts, k=51):
    """Numbers of the words of each text that are in k words in a row which stand in another text."""
    places = collections.defaultdict(list)
    for i, t in texts.items():
        words = t.split()
        for j in range(len(words) - k + 1):
            places[tuple(words[j : j + k])].append((i, j))
    out = collections.defaultdict(set)
    for held in places.values():
        if len({i for i, _ in held}) > 1:
            for i, j in held:
                out[i].update(range(j, j + k))
    return dict(out)


def edited_copies(n, share, seed):
    rng = random.Random(seed)
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(300)]
    return {i: " ".join(f"v{rng.randrange(10**7)}" if rng.random() < share else w for w in base) for i in range(n)}


def short_passages(n, seed):
    """Pairs of texts with one passage of 51 words of a letter or two, the rest random."""
    rng = random.Random(seed)
    words = lambda n: [f"{rng.choice('abcdefghijklmnopqrst')}{rng.choice(['', *'abcdefghi'])}" for _ in range(n)]
    texts = {}
    for k in range(n):
        passage = words(51)
        for copy in range(2):
            texts[2 * k + copy] = " ".join([*words(rng.randint(0, 60)), *passage, *words(rng.randint(0, 60))])
    return texts


def found_spans(spark, operator, texts):
    rows = operator.repeated_passages(docs_of(spark, [(i, t, "en", "s", 1) for i, t in texts.items()])).collect()
    check_spans(rows, texts)
    return covered(rows, texts)


@pytest.mark.parametrize("operator", [chunk_dedup, suffix_dedup])
def test_passages_of_edited_copies(spark, operator):
    for share in (0.02, 0.05):
        texts = edited_copies(200, share, 4)
        assert found_spans(spark, operator, texts) == brute_cover(texts)


def test_short_passages(spark):
    texts = short_passages(1500, 5)
    want = brute_cover(texts)
    assert len(want) == len(texts)
    assert found_spans(spark, chunk_dedup, texts) == want


@pytest.mark.parametrize("operator", [chunk_dedup, suffix_dedup])
def test_repeats_of_repeats(spark, operator):
    """A passage that one of two texts holds more than once, and runs of one word of different lengths."""
    texts = short_passages(3, 6)
    passage = " ".join(f"p{i}" for i in range(55))
    texts |= {10: f"a {passage} b", 11: f"c {passage} d {passage} e", 12: f"{passage} f {passage}", 20: "w " * 300, 21: "x " + "w " * 80, 22: "y " + "w " * 2000}
    assert found_spans(spark, operator, texts) == brute_cover(texts)


def test_many_partitions_lose_no_neighbours(spark):
    """Pairs with a passage of 51 words give the same spans whatever the number of partitions."""
    texts = short_passages(300, 9)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "150")
        assert found_spans(spark, suffix_dedup, texts) == brute_cover(texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_gear_hash_is_a_rolling_hash():
    raw = np.frombuffer(b"some bytes that roll through a window " * 4, np.uint8)
    got = chunk_dedup.gear_hashes(raw, np.array([0, 50, len(raw)]))
    h = 0
    for i, b in enumerate(raw.tolist()):
        h = 0 if i == 50 else h
        h = (2 * h + int(chunk_dedup._GEAR[b])) % 2**32
        assert got[i] == h


def test_chunks_resist_insertions():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefgh ij"), 4000))
    ends = lambda t: set(chunk_dedup.chunk_ends(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0])
    before, after = ends(text), {e - 7 for e in ends(text[:100] + "INSERT!" + text[100:])}
    assert len(before & after) > 0.8 * len(before)


def test_minimisers_cover_every_window():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    docs = np.repeat([0, 1, 2], [300, 20, 180])
    at = suffix_dedup.minimisers(h, docs)
    for lo, hi in ((0, 300), (320, 500)):
        for i in range(lo, hi - suffix_dedup.SPAN + 1):
            window = np.arange(i, i + suffix_dedup.SPAN)
            assert window[(h[window] >> np.uint64(1)).argmin()] in at
    assert 300 + (h[300:320] >> np.uint64(1)).argmin() in at
    assert len(at) < 500 * 3 / suffix_dedup.SPAN + 5


def test_extend():
    a, b = b"xx one two three yy", b"zz one two three ww"
    assert passages.extend(a, b, 5, 5) == (3, 16, 3)
    assert passages.extend(a, b, 0, 0) is None
    assert passages.extend(b"one twofold", b"one two", 0, 0) == (0, 3, 1)
    assert passages.extend(b"some", b"awesome", 1, 4) is None


def test_shingle_sets_of_short_texts():
    sets = near_dedup.shingle_sets(pa.array(["", "A", "a", "a b", "A  B\n", "a b c"]), 2)
    assert [len(s) for s in sets] == [0, 1, 1, 1, 1, 2]
    assert sets[1].tolist() == sets[2].tolist() and sets[3].tolist() == sets[4].tolist()
    assert PASSAGE


# -- identity, borders, odd passages ------------------------------------------------------------------------


def thue_morse(n):
    """A word over a and b, and its complement: equal hashes in every base modulo a power of two."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_unlike_words_are_not_linked(spark):
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        a, b = thue_morse(n)
        rows += [(10 * k, a + " x"), (10 * k + 1, b + " x"), (10 * k + 2, a + " x"), (10 * k + 3, a), (10 * k + 4, b)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {i: i - 2 if i % 10 == 2 else i for i, _ in rows}


def hard_passages(seed):
    """Equal texts, 51 words of one letter, a passage whose halves lie first elsewhere, one twice in a text."""
    rng = random.Random(seed)
    letters = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)]
    words = lambda n: [f"{rng.choice('äöüé')}{rng.randrange(10**5)}" for _ in range(n)]
    texts, i = {}, 0
    for _ in range(12):
        same, short, long = " ".join(words(90)), letters(51), words(60)
        twice = " ".join(words(55))
        rows = [same, same, " ".join([*letters(30), *short, *letters(9)]), " ".join([*letters(3), *short, *letters(40)])]
        rows += [" ".join([*words(5), *long[:40], *words(5)]), " ".join([*words(9), *long[20:], *words(5)]), " ".join([*words(7), *long, *words(5)]), " ".join([*words(2), *long, *words(2)])]
        rows += [f"x {twice} yy {twice} z", f"{twice} only", "\n".join(words(50))]
        for t in rows:
            texts[i] = t
            i += 1
    return texts


@pytest.mark.parametrize("operator", [chunk_dedup, suffix_dedup])
@pytest.mark.parametrize("partitions", [1, 4, 50, 200])
def test_spans_whatever_the_partitions(spark, operator, partitions):
    texts = hard_passages(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        assert found_spans(spark, operator, texts) == brute_cover(texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("operator", [chunk_dedup, suffix_dedup])
@pytest.mark.parametrize("width", [4, 13, 30])
def test_shorter_passages(spark, operator, width):
    """Other lengths of a passage, down to windows with less room than a chunk needs."""
    rng = random.Random(width)
    texts = {i: " ".join(rng.choice(["a", "bb", "ccc", "x" * 40, "éé"]) for _ in range(rng.randint(0, 3 * width))) for i in range(60)}
    texts |= {100 + i: texts[i] + " tail" for i in range(0, 60, 7)}
    rows = operator.repeated_passages(docs_of(spark, [(i, t, "en", "s", 1) for i, t in texts.items()]), width).collect()
    assert covered(rows, texts) == brute_cover(texts, width)


def shared_ids():
    passage = " ".join(f"wörd{i}é" for i in range(60))
    other = " ".join(f"zz{i}🙂" for i in range(70))
    rows = [(1, f"ä ö {passage} ü"), (2, f"é {passage}"), (2, "nothing that repeats, ümlaut here " + " ".join(f"q{i}" for i in range(200))), (2, f"{other} é"), (3, f"{other} - {passage}"), (3, "short")]
    left = [(1, f"ä ö {passage} ü"), (2, "é"), (2, rows[2][1]), (2, f"{other} é"), (3, "-"), (3, "short")]
    return rows, left


@pytest.mark.parametrize("operator", [chunk_dedup, suffix_dedup])
def test_rows_with_one_id_keep_their_own_texts(spark, operator):
    rows, left = shared_ids()
    docs = docs_of(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = operator.without_repeats(docs).collect()
    assert sorted((r["doc_id"], " ".join(r["text"].split())) for r in got) == sorted(left)
    assert all(r["n_chars"] == len(r["text"]) for r in got if (r["doc_id"], r["text"]) not in rows)


def test_the_pipeline_keeps_rows_with_one_id_apart(spark, sf):
    import corpus_pipeline

    rows, left = shared_ids()
    got = corpus_pipeline.drop_repeated_passages(spark, docs_of(spark, [(i, t, "en", "s", 1) for i, t in rows]), sf).collect()
    assert sorted((r["doc_id"], " ".join(r["text"].split())) for r in got) == sorted(left)


def test_suffixes_sort_by_their_texts():
    texts = pa.array(["one two three four five six seven", "zero one two three four five six seven", "", "a b"])
    doc, head, more, gram, first, last = suffix_dedup.suffixes(texts, 5)
    raw = [t.encode() for t in texts.to_pylist()]
    for d, h, m, a, b in zip(doc.tolist(), head.tolist(), more.tolist(), first.tolist(), last.tolist(), strict=True):
        begin = ((h + (1 << 63)) << 64 | (m + (1 << 63))).to_bytes(16, "big").rstrip(b"\0")
        assert begin in raw[d] and a <= b
    assert set(doc.tolist()) == {0, 1} and set(gram[doc == 0].tolist()) & set(gram[doc == 1].tolist())


def in_batches(rows, cuts, size):
    """Partitions of a table at these cuts, each in batches of ``size`` rows."""
    for a, b in zip([0, *cuts], [*cuts, rows.num_rows], strict=True):
        yield iter([rows.slice(i, min(size, b - i)) for i in range(a, b, size)])


@pytest.mark.parametrize("size", [1, 2, 3, 10])
def test_edges_of_ranges_are_compared(size):
    """Every split of sorted runs into three partitions finds the same runs, rows at the edges included."""
    key, span = [1, 1, 3, 5, 7, 7, 7, 8, 9, 9], [4, 4, 1, 1, 2, 2, 3, 1, 6, 6]
    zeros = pa.array(np.zeros(10, np.int64))
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(10)), zeros, pa.array(key), zeros, zeros, pa.array(span)], passages.RUN)
    for a in range(11):
        for b in range(a, 11):
            sure, edges, meets = set(), [], {}
            for part in in_batches(rows, [a, b], size):
                for out in passages._with_neighbours(part):
                    for r in out.to_pylist():
                        sure |= {r["doc"]} if r["sure"] else set()
                        edges += [(r["key"], r["doc"])] if r["edge"] else []
                        meets[r["doc"]] = r["other"]
            met = {k for k, _ in edges if sum(x == k for x, _ in edges) > 1}
            assert sure | {d for k, d in edges if k in met} == {0, 1, 4, 5, 6, 8, 9}, (a, b)
            # The first of equal runs in a partition stands for itself.
            assert {d: o for d, o in meets.items() if o is not None} == {d: d - 1 for d in (1, 5, 9) if d not in (a, b)}


@pytest.mark.parametrize("size", [1, 3, 20])
def test_windows_in_several_ranges_meet_the_first(size):
    digest, doc = [1, 1, 2, 3, 3, 3, 3, 4, 5, 5], [0, 5, 1, 2, 2, 3, 4, 9, 7, 8]
    rows = pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.zeros(10, np.int64)), pa.array(digest)], ["doc", "mark", "digest"])
    for a in range(11):
        for b in range(a, 11):
            pairs, edges = set(), collections.defaultdict(set)
            for part in in_batches(rows, [a, b], size):
                for out in passages._to_first(part):
                    for r in out.to_pylist():
                        if r["edge"]:
                            edges[r["digest"]].add(r["doc"])
                        else:
                            pairs.add((r["doc"], r["other"]))
            pairs |= {(d, min(docs)) for docs in edges.values() for d in docs if d != min(docs)}
            assert all(x > y for x, y in pairs)
            roots = {d: d for d in doc}
            for x, y in sorted(pairs):
                roots[x] = roots[y]
            assert roots == {0: 0, 5: 0, 1: 1, 2: 2, 3: 2, 4: 2, 9: 9, 7: 7, 8: 7}, (a, b)


@pytest.mark.parametrize("most", [200_000, 2])
def test_cutting_moves_only_what_is_cut(spark, monkeypatch, most):
    """The texts that lose nothing are not shuffled, however many spans there are for a broadcast by size."""
    monkeypatch.setattr(passages, "BROADCAST_IDS", most)
    rows = [(i, f"text {i} of many", 0) for i in range(40)] + [(None, "no id", 0), (3, "another of three", 0), (50, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    marks = docs.where("doc_id IN (3, 7, 9)").selectExpr("doc_id", "xxhash64(text) AS mark", "5L AS start", "7L AS end").where("mark != xxhash64('another of three')")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = passages.cut_out(docs, marks)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    texts = [(i, t if t is None or i not in (3, 7, 9) or t.startswith("another") else f"text {t[7:]}") for i, t, _ in rows]
    assert got == sorted([(i, t, None if t is None else len(t)) for i, t in texts], key=repr)
    if most > 2:
        assert "left_anti" in plan.lower().replace("leftanti", "left_anti") and "BroadcastHashJoin" in plan
