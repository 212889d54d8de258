"""The pipeline: stages in order, each against what it got, and its rows against plain versions."""

import collections
import re

import pytest

import corpus_pipeline
from ballotline.llm import mixing
from tests.llm import test_decontam, test_linededup, test_simhash
from tests.llm.test_mixing import checked as mixed_well

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, DATA).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns(spark, stages):
    names = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert all(after.columns == names for _, after in stages[:-1])
    assert stages[-1][1].columns == [*names, "mix_epoch", "mix_shard"]


def test_toxicity(spark, stages):
    before, after = stages[0]
    gone = before.join(after, "doc_id", "left_anti").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    assert gone and sum(r.toxic for r in gone) >= 0.9 * len(gone)
    assert after.count() > 0.9 * before.count()


def test_line_dedup(stages):
    before, after = stages[1]
    want = {d: t for (d, _), t in test_linededup.plain_runs(test_linededup.keyed(before)).items()}
    assert {r.doc_id: r.text for r in after.collect()} == want


def test_near_dedup(stages):
    before, after = stages[2]
    rows = before.collect()
    want = test_simhash.least([r.doc_id for r in rows], [test_simhash.plain(r.text) for r in rows])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(want.values()))


def test_decontamination(spark, stages):
    before, after = stages[3]
    bench = [(b.item_id, b.text) for b in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = test_decontam.plain([(r.doc_id, r.text) for r in before.collect()], bench)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, items in want.items() if not items)


def test_mixing(stages):
    before, after = stages[4]
    copies = collections.Counter(r.doc_id for r in after.collect())
    report = mixing.mix_report(before).collect()
    mixed_well(report, before.select("doc_id", "text", "source").collect())
    assert all(copies[r.doc_id] * r["size"] == r.taken for r in report)
    for r in after.limit(50).collect():
        assert re.search(r"\S", r.text) and 0 <= r.mix_shard < mixing.SHARDS and r.mix_epoch in (0, 1)


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, DATA)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, stages[-1][1].collect()))
