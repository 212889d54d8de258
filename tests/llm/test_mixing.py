"""Mixing: targets against a loop, taken words against targets, exact quotas, reruns and edge cases."""

import collections
import re

import pytest

from ballotline.llm import mixing

DATA = "/root/testdata/sf0.01"


def wanted(size: dict) -> dict:
    """Targets by resharing until none is above its stop."""
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, out, open_ = 1.5 * sum(size.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * size[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2 * size[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def checked(rows: list, docs: list) -> None:
    words = collections.Counter()
    for d in docs:
        words[d["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    want, src = wanted(dict(words)), {d["doc_id"]: d["source"] for d in docs}
    taken, most = collections.Counter(), collections.Counter()
    for r in rows:
        s = src[r["doc_id"]]
        assert r["source_size"] == words[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 2 * r["size"] and len(r["shards"]) * r["size"] == r["taken"]
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    for s in words:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6, s


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count()
    checked(rows, docs.select("doc_id", "text", "source").collect())
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mix_rows_follow_the_report(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    copies = collections.Counter(r["doc_id"] for r in mixing.mix(docs).select("doc_id").collect())
    for r in mixing.mix_report(docs).collect():
        assert copies[r["doc_id"]] == (r["taken"] // r["size"] if r["size"] else 0)


def test_quotas_are_exact(spark):
    held = [("a", 100), ("b", 37), ("c", 1), ("d", 0)]
    for shards in (1, 3, 8):
        rows = mixing.split_tree(spark.createDataFrame(held, "src string, quota long"), shards).collect()
        by, per = collections.Counter(), collections.Counter()
        for r in rows:
            by[r["src"]] += r["quota"]
            per[r["shard"]] += r["quota"]
        assert all(by[s] == q for s, q in held)
        assert max(per.values()) - min(per.values()) <= 3 and max(per) < shards


def test_draws_follow_the_hypergeometric_law(spark):
    held = spark.createDataFrame([(f"s{k}", 50) for k in range(300)], "src string, quota long")
    left = [r["quota"] for r in mixing.split_tree(held, 2).where("shard = 0").collect()]
    left += [0] * (300 - len(left))
    n, share = 300 * 50, 50 / (300 * 50)
    assert sum(left) == n // 2
    law = n / 2 * share * (1 - share) * (n / 2) / (n - 1)
    assert 0.7 * law < sum((x - 25) ** 2 for x in left) / 300 < 1.4 * law
    other = [r["quota"] for r in mixing.split_tree(held, 2, seed=8).where("shard = 0").collect()]
    assert sorted(left) != sorted(other)


def test_very_many_sources(spark):
    held = spark.range(100_000).selectExpr("concat('s', id) AS src", "1 + id % 3 AS quota")
    rows = mixing.split_tree(held, 16)
    assert rows.groupBy("src").sum("quota").join(held, "src").where("quota <> `sum(quota)`").count() == 0
    per = [r["n"] for r in rows.groupBy("shard").agg({"quota": "sum"}).toDF("shard", "n").collect()]
    assert sum(per) == 199_999 and len(per) == 16 and max(per) - min(per) <= 4
    assert mixing._dimensions(15 * 10**12, None) == (300_000, 22) and mixing._dimensions(10**6, None) == (16, 10)


def test_edges(spark):
    schema = "doc_id long, text string, source string, size int, mix_shard string"
    rows = [(1, None, "a", 1, "x"), (2, "", "a", 1, "x"), (3, "w " * 500, "a", 1, "x"), (4, "w v", None, 1, "x"), (4, "w v", None, 1, "x"), (None, "u", "ä", None, None), (6, "q r s", "b", 1, "x")]
    docs = spark.createDataFrame(rows, schema)
    out = mixing.mix_report(docs).collect()
    assert len(out) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in out)
    assert [r["size"] for r in out if r["doc_id"] in (1, 2)] == [0, 0]
    assert set(mixing.mix(docs).columns) == {"doc_id", "text", "source", "size", "mix_epoch", "mix_shard"}
    mixing.mix(docs).collect()
    assert mixing.mix_report(docs.limit(0)).collect() == []
    assert mixing.mix(docs.limit(0)).collect() == []
    assert {r["target"] for r in mixing.mix_report(docs.where("doc_id < 3")).collect()} == {0.0}
