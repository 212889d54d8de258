"""Toxicity: held-out accuracy, features against a plain loop, what may not matter, edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from ballotline.llm import toxicity

DATA = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(rows) == docs.count()
    truth = {x.doc_id: x.toxic for x in labels.collect()}
    held = [(truth[d], r) for d, r in rows.items() if r.held_out and d in truth]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    s, y = np.array([r.score for _, r in held]), np.array([t for t, _ in held])
    auc = (s[y == 1][:, None] > s[y == 0]).mean()
    caught = [t for t, r in held if r.predicted]
    assert auc > 0.97 and np.mean(caught) > 0.95 and sum(caught) > 0.65 * y.sum()
    # labels of held-out rows and other columns change nothing
    other = labels.withColumn("toxic", toxicity.F.when(toxicity._held_out("doc_id"), 1 - labels.toxic).otherwise(labels.toxic))
    again = {r.doc_id: r.score for r in toxicity.score(docs.drop("lang", "source").repartition(3), other).collect()}
    assert again == {d: r.score for d, r in rows.items()}


def test_places():
    cache = toxicity._Hashes()
    got = np.concatenate(list(toxicity.places("A b, c! Dé-e", cache)))
    assert len(got) == 5 + 5 + 4 + 3
    assert set(np.concatenate(list(toxicity.places("a b", cache))).tolist()) < set(np.concatenate(list(toxicity.places("x A  B", cache))).tolist())
    assert list(toxicity.places(None, cache)) == list(toxicity.places(" ,!", cache)) == []
    words = " ".join(f"w{k}" for k in range(70_000))
    assert sum(map(len, toxicity.places(words, cache))) == 70_000 * 2 + 69_999 + 69_998


def test_edges(spark):
    bad = "you are an idiot and a moron today"
    rows = [(k, f"{bad} {k}" if k % 3 == 0 else f"a lovely day in the park {k}", "x") for k in range(300)] + [(900, None, "x"), (901, "", None), (None, bad, "x"), (902, "wort " * 60_000, "x"), (902, "wort " * 60_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(900, 1), (901, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[None].predicted == 1 and not by[None].held_out and by[902].predicted == 0 and by[900].score == by[901].score
    assert all(by[k].predicted == (k % 3 == 0) for k in range(300))
    clash = docs.withColumn("__score", F.lit(1)).withColumn("__text", F.lit("x")).withColumn("c0", F.lit(2))
    assert toxicity.drop_toxic(clash, labels).columns == clash.columns and len(toxicity.score(clash, labels).collect()) == clash.count()
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == len(rows) - 101
    assert toxicity.score(docs.limit(0), labels).collect() == []
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.5}


def test_places_of_one_text_are_learned():
    import pyarrow as pa

    from ballotline.llm import toxicity

    sets = [[1, 7], *[[1]] * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(21), pa.int64()), pa.array([1] + [0] * 20, pa.int32()), pa.array(sets, pa.list_(pa.int32()))], names=["turn", "label", "places"])
    out = pa.Table.from_batches(toxicity._train(iter([batch]))).to_pydict()
    assert dict(zip(out["place"], out["weight"])).get(7, 0) > 0


def test_training_against_a_plain_loop():
    """FTRL-proximal written out for one number at a time."""
    import math
    import random

    import pyarrow as pa

    rnd = random.Random(4)
    sets = [sorted(rnd.sample(range(60), rnd.randrange(0, 12))) for _ in range(400)]
    labels = [int(sum(p < 8 for p in s) > 1) for s in sets]
    rows = {"turn": pa.array(range(400), pa.int64()), "label": pa.array(labels, pa.int32()), "places": pa.array(sets, pa.list_(pa.int32()))}
    parts = [pa.RecordBatch.from_arrays([a[k : k + 150] for a in rows.values()], names=list(rows)) for k in range(0, 400, 150)]
    out = pa.Table.from_batches(toxicity._train(iter(parts))).to_pydict()
    bias, z, n = 1 << toxicity.BITS, {}, {}
    seen = {p: sum(p in s for s in sets) for p in range(60)}
    value = {p: min(max(math.log(401 / max(c, 1)) / math.log(201), 0), 1) for p, c in seen.items()} | {bias: 1.0}

    def weight(p):
        l1 = 0 if p == bias else toxicity.L1
        if abs(z.get(p, 0)) <= l1:
            return 0.0
        return -math.copysign(abs(z[p]) - l1, z[p]) / ((toxicity.BETA + math.sqrt(n[p])) / toxicity.ALPHA + (0 if p == bias else toxicity.L2))

    for _ in range(toxicity.EPOCHS):
        for s, label in zip(sets, labels):
            w = {p: weight(p) for p in [*s, bias]}
            guess = 1 / (1 + math.exp(-sum(w[p] * value[p] for p in w)))
            for p in w:
                g = (guess - label) * value[p] * (toxicity.TOXIC_WEIGHT if label else 1)
                rate = (math.sqrt(n.get(p, 0) + g * g) - math.sqrt(n.get(p, 0))) / toxicity.ALPHA
                z[p], n[p] = z.get(p, 0) + g - rate * w[p], n.get(p, 0) + g * g
    want = {p: weight(p) * value[p] for p in z if weight(p)}
    got = dict(zip(out["place"], out["weight"]))
    assert set(got) == set(want) and len(want) < 61 and all(math.isclose(got[p], w, rel_tol=1e-6, abs_tol=1e-9) for p, w in want.items())
    assert min(want[p] for p in range(8) if p in want) > 0 > want[bias]
