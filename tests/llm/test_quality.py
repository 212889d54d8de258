"""Quality rules: statistics against plain loops, the estimate against numpy rows, verdicts, edge cases."""

import collections
import math
import random
import re
import unicodedata

import numpy as np
import pytest

from ballotline.llm import quality

DATA = "/root/testdata/sf0.01"


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = collections.Counter(win)
    covered = {k + j for k, x in enumerate(win) if n[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def plain_vector(text):
    """The four statistics, word by word."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    share = lambda k: 2 * math.asin(math.sqrt((k + 0.375) / (len(w) + 0.75)))
    marked = sum(any(unicodedata.category(c)[0] not in "LMN" for c in x) for x in w)
    x = (math.log2(sum(min(len(x), 20) for x in w) / len(w)), share(sum(len(x) >= 8 for x in w)), share(marked), math.log2(len(set(w)) / len(w)))
    pull = math.sqrt(len(w) / (len(w) + 200))
    return [round((v - c) * pull * g) for v, c, g in zip(x, quality.CENTRE, quality.GRID)]


def plain_estimate(x):
    """Mean and covariance of rows by concentration steps over rows, from the same four starts."""
    guarded = lambda s: s + np.diag(np.maximum(quality.GUARD**2 - s.diagonal(), 0))
    far = lambda m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    low = lambda v: np.sort(v, 0)[(len(v) - 1) // 2]
    med = low(x).astype(float)
    mad = np.maximum(1.4826 * low(np.abs(x - med)), quality.GUARD)
    z = (x - med) / mad

    def correlated(scores):
        c = np.cov(np.round(1024 * scores).T, bias=True)
        d = np.sqrt(np.outer(c.diagonal(), c.diagonal()))
        r = np.divide(c, d, out=np.zeros_like(c), where=d > 0)
        r[np.diag_indices(4)] = 1
        return r * np.outer(mad, mad)

    norm = np.maximum(np.sqrt((z**2).sum(1, keepdims=True)), 1e-9)
    found = []
    for m, s in ((med, np.diag(mad**2)), (x.mean(0), np.cov(x.T, bias=True)), (med, correlated(np.tanh(z))), (med, correlated(z / norm))):
        s, last = guarded(s), math.inf
        for _ in range(quality.STEPS):
            ring = np.floor(32 * np.log2(far(m, s) + 2.0**-10))
            near = x[ring <= math.ceil(np.percentile(ring, 75))]
            k = round((len(near) / len(x) - 0.75) / 0.25 * 512)
            m2, s2 = near.mean(0), guarded(np.cov(near.T, bias=True) * quality.chi_scale(0.75 + 0.25 * max(k, 0) / 512))
            now = np.linalg.slogdet(s2)[1] / 2
            if not now < last - 1e-9:
                break
            m, s, last = m2, s2, now
        found.append((last, m, s))
    return min(found, key=lambda f: f[0])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    by_id = {d.doc_id: d for d in docs.collect()}
    rows = quality.verdicts(docs).collect()
    assert len(rows) == len(by_id)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == plain(by_id[r.doc_id].text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    # every verdict against estimates over rows
    groups = collections.defaultdict(list)
    vectors = {r.doc_id: plain_vector(by_id[r.doc_id].text) for r in rows if not r.base_failed}
    for k, v in vectors.items():
        for g in ((by_id[k].lang, by_id[k].source), (by_id[k].lang, 0), (0, 0)):
            groups[g].append(v)
    found = {g: plain_estimate(np.array(v)) for g, v in groups.items() if len(v) >= quality.LEAST}
    fixed, unlike = found[0, 0], 0
    for r in rows:
        if not r.base_failed:
            d = by_id[r.doc_id]
            m, s = next(found[g][1:] for g in ((d.lang, d.source), (d.lang, 0), (0, 0)) if g in found)
            x = np.array(vectors[r.doc_id])
            want = (x - m) @ np.linalg.inv(s) @ (x - m)
            assert r.distance == pytest.approx(want, rel=1e-6) and r.kept == (want <= quality.CUT)
            # one fixed ellipsoid would decide otherwise about some
            unlike += abs((x - fixed[1]) @ np.linalg.inv(np.diag(fixed[2].diagonal())) @ (x - fixed[1]) - want) > 0.2 * want
    assert unlike > 0.5 * len(vectors)
    # the estimates are those of the rows, not of the guard
    variances = np.array([f[2].diagonal() for f in found.values()])
    assert len(found) >= 5 and (variances > 2 * quality.GUARD**2).mean() > 0.95
    corr = [f[2][0, 1] / math.sqrt(f[2][0, 0] * f[2][1, 1]) for f in found.values()]
    assert np.median(corr) > 0.5
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    good = [k for q, k in judged if q == 1]
    assert sum(good) / len(good) > 0.98
    assert sum(not k for q, k in judged if q == 0) >= 0.9 * sum(q == 0 for q, _ in judged)
    again = quality.verdicts(docs.repartition(5)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_estimate_is_that_of_rows(spark):
    rnd = np.random.default_rng(1)
    x = rnd.multivariate_normal([100, 40, 30, 20], np.diag([400, 900, 1600, 2500]) + 100, 3000)
    x[:300] += 2000
    flat = np.stack([rnd.integers(0, 40, 200), np.full(200, 7), np.where(np.arange(200) < 190, 3, 500), rnd.integers(0, 9, 200)], 1)
    for y in (np.round(x).astype(int), flat):
        cells = spark.createDataFrame([("g", *map(int, r), 1) for r in y], "grp string, q0 long, q1 long, q2 long, q3 long, n long")
        got = quality.estimates(cells).first()
        last, m, s = plain_estimate(y)
        factor = np.array([[got[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
        assert got.logdet == pytest.approx(last, abs=1e-6)
        assert np.allclose([got[f"m{k}"] for k in range(4)], m, atol=1e-6) and np.allclose(factor @ factor.T, s, rtol=1e-6, atol=1e-6)
    # what is alike in the nearest rows has the guard, so that another value is far off
    assert s[1, 1] == s[2, 2] == quality.GUARD**2


def test_edges(spark):
    rnd = random.Random(0)
    clean = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rnd.randrange(99)) for _ in range(120))
    rows = [(k, clean(), "en", "s", 0) for k in range(80)] + [(100, None, "en", "s", 0), (101, "", None, "s", 0), (102, " ".join(w + "###" for w in clean().split()), "en", "s", 0), (103, clean(), None, None, None), (103, clean(), None, None, None)]
    rows.append((104, "wort zwei drei " * 60_000, "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    out = quality.verdicts(docs).collect()
    assert len(out) == len(rows)
    kept = collections.defaultdict(list)
    for r in out:
        kept[r.doc_id].append(r.kept)
    assert all(kept[k] == [True] for k in range(80)) and kept[103] == [True, True]
    assert kept[100] == kept[101] == kept[102] == kept[104] == [False]
    assert [r.n_repeat_words for r in out if r.doc_id == 104] == [180_000]
    assert quality.verdicts(docs.limit(0)).collect() == []
    assert [r.kept for r in quality.verdicts(docs.where("doc_id < 3")).collect()] == [True] * 3
