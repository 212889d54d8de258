"""The pruned search against comparing all pairs: random, tied, sparse and skewed references."""

import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ballotline.constants import VECTOR
from ballotline.functions.vectors import partition_key
from ballotline.operators import knn, tables
from ballotline.operators.knn import brute, pruned
from ballotline.operators.vote import decide, vote
from ballotline.plans import queries as plans
from ballotline.sources.index import build_index, read_index, write_index
from ballotline.sources.references import default_mcc_risk

COLS = ", ".join(f"{v} int" for v in VECTOR)


def frames(spark, queries, refs):
    q = spark.createDataFrame([(k, *v) for k, v in enumerate(queries)], f"qid long, {COLS}").withColumn("part_key", partition_key())
    r = spark.createDataFrame([(k, *v, y) for k, (v, y) in enumerate(refs)], f"ref_id long, {COLS}, label int")
    return q, r


def plain(queries, refs, k=5):
    out = {}
    for i, q in enumerate(queries):
        d = sorted((sum((a - b) ** 2 for a, b in zip(q, v)), j, y) for j, (v, y) in enumerate(refs))[:k]
        out[i] = [(rank + 1, j, y, d2) for rank, (d2, j, y) in enumerate(d)]
    return out


def rows(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r["rank"], r.ref_id, r.label, r.d2))
    return out


@pytest.mark.parametrize("seed,step,n", [(1, 1, 900), (2, 2500, 900), (3, 5000, 400), (4, 10000, 2000)])
def test_pruned_is_exact(spark, seed, step, n):
    """Coarse steps give many ties at the fifth place and many rows alike."""
    rnd = random.Random(seed)
    point = lambda: tuple(rnd.randrange(-10000 if i in (5, 6) else 0, 10001) // step * step for i in range(14))
    refs, queries = [(point(), rnd.randrange(2)) for _ in range(n)], [point() for _ in range(40)]
    q, r = frames(spark, queries, refs)
    want = plain(queries, refs)
    assert rows(brute(q, r)) == want
    assert rows(pruned(q, build_index(r, 32))) == want


def test_few_and_no_references(spark):
    q, r = frames(spark, [(0,) * 14, (9000,) * 14], [((1,) * 14, 1), ((5000,) * 14, 1)])
    found = pruned(q, build_index(r))
    assert rows(found) == plain([(0,) * 14, (9000,) * 14], [((1,) * 14, 1), ((5000,) * 14, 1)])
    assert [(x.fraud_count, x.approved, x.fraud_score) for x in decide(q.select("qid"), vote(found)).collect()] == [(2, True, 0.4)] * 2
    none = decide(q.select("qid"), vote(pruned(q, build_index(r.limit(0))))).collect()
    assert [(x.fraud_count, x.approved, x.fraud_score) for x in none] == [(0, True, 0.0)] * 2
    assert pruned(q.limit(0), build_index(r)).collect() == []


def test_hot_partition_and_copies(spark):
    rnd = random.Random(8)
    same = [((100,) * 14, 1)] * 600
    refs = same + [(tuple(rnd.randrange(0, 300) for _ in range(14)), 0) for _ in range(600)]
    queries = [(100,) * 14, (101,) * 14, (250,) * 14]
    q, r = frames(spark, queries, refs)
    assert rows(pruned(q, build_index(r, 32))) == plain(queries, refs)


def test_early_stop_is_another_answer(spark):
    """Eight frauds near enough for the search to stop, five legitimate ones nearer in another leaf."""
    base = (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    refs = [((1000, *base[1:]), 1)] * 8 + [(base[:9] + (1, *base[10:]), 0)] * 5
    q, r = frames(spark, [base], refs)
    held = build_index(r, 32)
    assert vote(pruned(q, held)).first().fraud_count == 0
    assert vote(pruned(q, held, early_stop=True)).first().fraud_count == 5
    far, _ = frames(spark, [(9000,) * 14], refs)
    assert rows(pruned(far, held, early_stop=True)) == plain([(9000,) * 14], refs)


def test_plan(spark):
    q, r = frames(spark, [(0,) * 14], [((k,) * 14, k % 2) for k in range(500)])
    plan = pruned(q, build_index(r, 32))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_blocks_of_queries(spark, monkeypatch):
    rnd = random.Random(4)
    point = lambda: tuple(rnd.randrange(0, 10001) for _ in range(14))
    refs, queries = [(point(), 0) for _ in range(300)], [point() for _ in range(30)]
    q, r = frames(spark, queries, refs)
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(knn, "WANTED_ROWS", 20)
    monkeypatch.setattr(knn, "SAMPLE", 50)
    assert rows(brute(q.union(q.limit(3)), r)) == rows(pruned(q, build_index(r, 32))) == plain(queries, refs)


def test_scan_of_a_written_index_skips(spark, tmp_path):
    rnd = random.Random(6)
    refs = [(tuple(rnd.randrange(0, 10001) for _ in range(14)), 0) for _ in range(3000)]
    q, r = frames(spark, [refs[5][0], refs[9][0]], refs)
    write_index(build_index(r, 32), default_mcc_risk(spark), str(tmp_path / "index"))
    index, _ = read_index(spark, str(tmp_path / "index"))
    assert rows(pruned(q, index)) == plain([refs[5][0], refs[9][0]], refs)
    first = knn._first_leaf(q, index).join(q.drop("part_key"), "qid").withColumn("bound", F.lit(10**9))
    plan = knn._scan(first, index)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part_key#\d+ ", plan) and re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(leaf_id", plan), plan


def test_shared_folder_is_needed_on_a_cluster():
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(SimpleNamespace(sparkContext=context))


def test_scores_ignore_other_columns(spark):
    q, r = frames(spark, [(0,) * 14], [((k,) * 14, k % 2) for k in range(50)])
    r = r.withColumn("d2", F.lit("x")).withColumn("part_key", F.lit(3)).withColumn("qid", F.lit(None).cast("string"))
    q = q.withColumn("label", F.lit(7)).withColumn("d2", F.lit(1))
    assert rows(pruned(q, build_index(r))) == plain([(0,) * 14], [((k,) * 14, k % 2) for k in range(50)])


def _no_pairs(*_):
    raise AssertionError("compares all pairs")


def test_many_pairs_are_pruned(spark, monkeypatch):
    rnd = random.Random(12)
    point = lambda: tuple(rnd.randrange(0, 10001) // 2500 * 2500 for _ in range(14))
    refs, queries = [(point(), rnd.randrange(2)) for _ in range(600)], [point() for _ in range(20)]
    q, r = frames(spark, queries, refs)
    holes = q.limit(1).withColumn("qid", F.lit(99).cast("long")).withColumn("v3", F.lit(None).cast("int"))
    q, r = q.union(q.limit(3)).union(holes), r.union(r.limit(2).withColumn("v7", F.lit(None).cast("int")))
    want = plain(queries, refs)
    assert rows(knn.nearest(q, r)) == want
    monkeypatch.setattr(knn, "PAIRS", 1000)
    monkeypatch.setattr(knn, "brute", _no_pairs)
    assert rows(knn.nearest(q, r)) == want


def test_knn_top5_at_size(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = rows(brute(*plans._split(spark, sf)))
    monkeypatch.setattr(knn, "PAIRS", 1000)
    monkeypatch.setattr(knn, "brute", _no_pairs)
    assert rows(plans.knn_top5(spark, sf)) == want


def test_knn_vote_at_size(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    q, r = plans._split(spark, sf)
    want = {(x.qid, x.fraud_count) for x in decide(q.select("qid"), vote(brute(q, r))).collect()}
    monkeypatch.setattr(knn, "PAIRS", 1000)
    monkeypatch.setattr(knn, "brute", _no_pairs)
    assert {tuple(x) for x in plans.knn_vote(spark, sf).collect()} == want
