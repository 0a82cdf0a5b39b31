"""Operators 1, 8 and 9: scores, languages, rules."""

import zlib

import numpy as np
import pytest

from pathweave.llm import doc_stats, language_id, quality, quality_rules
from pathweave.llm.queries import op1_quality_classifier, op8_language_id, op9_quality_rules

from .conftest import ROWS


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_language_id_on_odd_rows(spark, odd, none):
    filters = language_id.fit(odd)
    assert filters.languages == ["de", "en", "es", "fr"] or set(filters.languages) <= {"de", "en", "es", "fr"}
    got = language_id.identify(odd, filters).collect()
    assert len(got) == len(ROWS)
    assert {c for c in odd.columns} <= set(got[0].asDict())
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0 <= r["score"] <= 1
    empty = language_id.fit(none)
    assert language_id.identify(none, filters).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, empty).collect()} == {"und"}


def test_filters_have_every_ngram_and_few_others():
    texts = ["alpha beta gamma", "delta epsilon"]
    h, doc, letters = language_id.grams(texts)
    assert letters.tolist() == [14, 12]
    slots = np.zeros((1 << 12, 1), np.uint8)
    bank = language_id.LanguageFilters(["a", "b"], slots, 3, np.zeros(2))
    for i in (0, 1):
        x = h[doc == i].copy()
        step = (x >> np.uint64(32)) | np.uint64(1)
        for _ in range(3):
            slots[(x & np.uint64(4095)).astype(int), 0] |= 1 << i
            x = x + step
    masks = bank.masks(h)[:, 0]
    assert all(masks[doc == 0] & 1) and all(masks[doc == 1] & 2)
    assert bank.predict(["gamma alpha"])[0] == ["a"]


def test_grams_do_not_cross_texts():
    one, _, _ = language_id.grams(["abc def"])
    both, doc, _ = language_id.grams(["abc def", "ghi"])
    assert both[doc == 0].tolist() == one.tolist()


def test_language_id_accuracy(spark, sf, texts):
    got = op8_language_id(spark, sf).toPandas()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    test = got[got.held_out]
    assert (test.held_out == test.doc_id.map(held)).all() and len(got) == len(texts)
    assert (test.lang_pred == test.doc_id.map(lang)).mean() >= 0.95


def test_quality_on_odd_rows(odd, none, labels):
    model = quality.fit(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    empty = quality.fit(none, labels.limit(0))
    assert quality.score(none, model).count() == 0
    assert {r["score"] for r in quality.score(odd, empty).collect()} == {0.5}


def test_quality_accuracy(spark, sf):
    got = op1_quality_classifier(spark, sf).toPandas()
    mark = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    test = got[got.held_out & got.doc_id.isin(mark)]
    assert ((test.predicted == test.doc_id.map(mark)).mean()) >= 0.9


def test_non_negative_risk_and_slopes():
    rng = np.random.default_rng(0)
    fp, fu = rng.normal(1, 1, 50), rng.normal(0, 1, 80)
    for prior in (0.3, 0.9):
        risk, gp, gu = quality.risk_slopes(fp, fu, prior)
        loss = lambda x: np.logaddexp(0, -x)
        rest = loss(-fu).mean() - prior * loss(-fp).mean()
        assert risk == pytest.approx(prior * loss(fp).mean() + max(0, rest))
        if rest > 0:
            step = np.zeros(50)
            step[3] = 1e-6
            assert (quality.risk_slopes(fp + step, fu, prior)[0] - risk) / 1e-6 == pytest.approx(gp[3], abs=1e-6)
        else:
            assert (gu <= 0).all() and (gp >= 0).all()


def test_prior_from_scores():
    rng = np.random.default_rng(1)
    p = rng.normal(2, 1, 4000)
    u = np.concatenate([rng.normal(2, 1, 2400), rng.normal(-2, 1, 1600)])
    assert quality.estimate_prior(p, u) == pytest.approx(0.6, abs=0.05)


def base_counts(text):
    """The base rules' counts, word for word as they are stated."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_rules_base_counts(spark, sf, texts, odd, none, labels):
    got = op9_quality_rules(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(texts)
    for i, text in texts.items():
        if len(text) < 6000:
            assert tuple(got.loc[i, doc_stats.BASE]) == base_counts(text), i
    failed = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
    assert (got.base_failed == failed).all()
    assert not (got.kept & got.base_failed).any()
    trees = quality_rules.fit(odd, labels)
    rows = quality_rules.apply_rules(odd, trees).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r["text"] is None or len(r["text"]) < 5000:
            assert tuple(r[b] for b in doc_stats.BASE) == base_counts(r["text"])
    assert quality_rules.apply_rules(none, quality_rules.fit(none, labels)).count() == 0


def test_symbols_and_lines():
    x = "# a * b\n# a * b\n\n \n<x> & | % $\n# a * b"
    base, _ = doc_stats.measure(__import__("pyarrow").array([x, None, ""]))
    assert [tuple(int(base[b][i]) for b in doc_stats.BASE) for i in range(3)] == [base_counts(x), (0,) * 5, (0,) * 5]


def test_trees_fit_and_are_monotonic():
    rng = np.random.default_rng(2)
    x = rng.random((1500, 3))
    y = ((x[:, 0] > 0.6) ^ (rng.random(1500) < 0.05)).astype(float)
    trees = quality_rules.grow(x, y, np.array([1, 0, -1]), trees=30)
    assert ((trees.probability(x) > 0.5) == (y > 0.5)).mean() > 0.93
    grid = np.linspace(0, 1, 60)
    for _ in range(20):
        point = np.repeat(rng.random((1, 3)), 60, 0)
        up, down = point.copy(), point.copy()
        up[:, 0], down[:, 2] = grid, grid
        assert (np.diff(trees.margin(up)) >= -1e-12).all()
        assert (np.diff(trees.margin(down)) <= 1e-12).all()


def test_trees_without_two_classes():
    for y in (np.zeros(5), np.ones(5), np.zeros(0)):
        trees = quality_rules.grow(np.zeros((len(y), 2)), y, np.zeros(2))
        assert len(trees.roots) == 0 and trees.probability(np.zeros((3, 2))).shape == (3,)


# -- whole texts and scores, word for word ------------------------------------------------------------------


def quick_base_counts(text):
    """As :func:`base_counts`, in time that long texts allow."""
    import collections
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = collections.Counter(windows)
    marked = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_rules_base_counts_of_long_texts(spark, sf, texts, odd, labels):
    got = op9_quality_rules(spark, sf).toPandas().set_index("doc_id")
    assert max(map(len, texts.values())) > 6000  # beyond what the test above looks at
    for i, text in texts.items():
        assert tuple(got.loc[i, doc_stats.BASE]) == quick_base_counts(text), i
        if len(text) < 2000:
            assert quick_base_counts(text) == base_counts(text)
    for r in quality_rules.apply_rules(odd, quality_rules.fit(odd, labels)).collect():
        assert tuple(r[b] for b in doc_stats.BASE) == quick_base_counts(r["text"])


def walk(trees, x):
    """The badness of one row of statistics, node by node."""
    total = trees.start
    for root in trees.roots.tolist():
        at = root
        while trees.feature[at] >= 0:
            at = int(trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at])
        total += trees.value[at]
    return 1 / (1 + np.exp(-total))


def test_rules_verdicts(spark, sf, texts):
    import pyarrow as pa

    docs, marks = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    trees = quality_rules.fit(docs, marks)
    for r in op9_quality_rules(spark, sf).collect():
        bad = walk(trees, doc_stats.measure(pa.array([texts[r["doc_id"]]]))[1][0])
        assert r["bad_score"] == pytest.approx(bad, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and bad < 0.5)


def statistics(text):
    """The eighteen statistics, one by one."""
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.split()]
    n, n_lines, distinct = max(len(words), 1), max(len(lines), 1), set(words)
    count = lambda chars: sum(raw.count(c.encode()) for c in chars)
    lower, upper = sum(97 <= b <= 122 for b in raw), sum(65 <= b <= 90 for b in raw)
    digit, space = sum(48 <= b <= 57 for b in raw), sum(b in b" \t\n\r\x0b\x0c" for b in raw)
    symbol, point, shout = count("#*$%&|<>"), count(".,;:'\"()-"), count("!?")
    lead, cont = sum(b >= 0xC0 for b in raw), sum(0x80 <= b < 0xC0 for b in raw)
    other = len(raw) - lower - upper - digit - space - symbol - point - shout - lead - cont
    solid, letters = max(len(raw) - cont - space, 1), max(lower + upper, 1)
    dup, repeat = quick_base_counts(text)[3:]
    return [
        np.log1p(len(words)) / 10, min(solid / n / 20, 2), symbol / solid, upper / letters, digit / solid, point / solid, shout / solid, other / solid, lead / solid,
        min(symbol / n, 3) / 3, dup / n_lines, repeat / n, len(distinct) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, min(n / n_lines / 100, 2),
        sum(len(x.split()) < 3 for x in lines) / n_lines, np.log1p(len(lines)) / 10, sum(w.isupper() for w in words) / n,
    ]


def test_quality_scores(spark, sf, texts):
    """The query's scores are the fitted network's, unit by unit, on each whole text."""
    docs, marks = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, marks)
    assert 0.6 < model.prior < 0.98
    a, b, c, d = model.weights
    for r in op1_quality_classifier(spark, sf).collect():
        x = statistics(texts[r["doc_id"]])
        z = [min(6, max(-6, (v - m) / s)) for v, m, s in zip([*x, *(max(v, 0) ** 0.5 for v in x)], model.mean, model.scale, strict=True)]
        margin = d[0] + sum(c[k] * np.tanh(b[k] + sum(v * a[i][k] for i, v in enumerate(z))) for k in range(len(c)))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-6)
        assert r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"])


def test_the_prior_needs_no_bad_marks(spark, sf):
    docs, marks = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    assert quality.fit(docs, marks).prior == quality.fit(docs, marks.where("quality = 1")).prior


def scalar_hash(gram):
    h = 0
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) % 2**64
    for _ in range(2):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
    return h ^ h >> 32


def test_language_scores(spark, sf, texts):
    """The query's languages and scores, n-gram by n-gram with one look into the filters for each."""
    filters = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    size = len(filters.slots)
    known = {}

    def carriers(gram):
        if gram not in known:
            h = scalar_hash(gram)
            places = [(h + k * (h >> 32 | 1)) % 2**64 % size for k in range(filters.hashes)]
            known[gram] = [all(filters.slots[p, i // 8] >> (i % 8) & 1 for p in places) for i in range(len(filters.languages))]
        return known[gram]

    for r in op8_language_id(spark, sf).collect():
        text = texts[r["doc_id"]] or ""
        if len(text) > 8000:
            continue  # the query's own work; plain Python takes too long here
        out = " "
        for ch in text:
            low = ch.lower() if len(ch.lower()) == 1 else ch
            out += low if ch.isalpha() else " " if out[-1] != " " else ""
        grams = [out[i : i + 4] for i in range(len(out) - 3)]
        hits = np.array([carriers(g) for g in grams]).reshape(-1, len(filters.languages)).sum(0)
        share = np.clip((hits / max(1, len(grams)) - filters.rates) / (1 - filters.rates), 0, 1)
        top, second = sorted(share)[-1], sorted(share)[-2]
        assert r["lang_pred"] == (filters.languages[int(share.argmax())] if any(map(str.isalpha, text)) else "und")
        assert r["score"] == pytest.approx(top * top / (top + second) if top else 0, abs=1e-9)


def test_samples_of_any_table_size(spark):
    from pathweave.llm.common import sampled

    ids = spark.range(200_000).withColumnRenamed("id", "doc_id")
    assert sampled(ids, "doc_id", 2.0, 3).count() == 200_000
    assert abs(sampled(ids, "doc_id", 0.01, 3).count() - 2000) < 300
    assert sampled(ids, "doc_id", 1e-9, 3).count() <= 1  # a share far below a millionth
    assert sampled(ids, "doc_id", 0.01, 3).exceptAll(sampled(ids.repartition(7), "doc_id", 0.01, 3)).count() == 0
