"""SimHash: fingerprints against a plain loop, components against all pairs, dense places, edge cases."""

import random
import re

import xxhash

from ballotline.llm import simhash
from ballotline.llm.components import components

DATA = "/root/testdata/sf0.01"


def plain(text: str | None) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def least(ids: list, fps: list) -> dict:
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = simhash.near_duplicates(docs).collect()
    text = {d.doc_id: d.text for d in docs.collect()}
    assert len(rows) == len(text)
    for r in rows[::7]:
        assert int(r.fingerprint, 16) == plain(text[r.doc_id]) and len(r.fingerprint) == 16
    want = least([r.doc_id for r in rows], [int(r.fingerprint, 16) for r in rows])
    assert all(r.component_id == want[r.doc_id] for r in rows)


def test_spark_hash_agrees(spark):
    assert spark.sql("SELECT xxhash64('éa b c') x").first().x == simhash._long(xxhash.xxh64_intdigest("éa b c".encode(), 42))


def test_dense_places(spark):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(4)}
    for b in list(fps):
        for _ in range(150):
            x = b
            for _ in range(rnd.choice([1, 2, 3, 4, 5])):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = {}
    for f, r in least(fps, fps).items():
        want.setdefault(r, set()).add(f)
    df = spark.createDataFrame([(simhash._long(f),) for f in fps], "fp long")
    for dense in (4, 64):
        comp = {r.node: r.root for r in components(simhash.links(df, dense)).collect()}
        got = {}
        for f in fps:
            got.setdefault(comp.get(simhash._long(f), simhash._long(f)), set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_edges(spark):
    long = "wort " * 70_000
    rows = [(5, None, 1), (3, "", 1), (4, " \n", 1), (9, "a", 1), (9, "A", 1), (None, "a", 1), (7, long, 1), (8, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = {}
    for r in simhash.near_duplicates(docs).collect():
        out.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert out[5] == out[3] == out[4] == [("0" * 16, 3)]
    assert out[9] == [out[9][0]] * 2 and out[None] == [out[9][0]] and out[9][0][1] == 9
    assert out[7][0][0] == f"{plain(long):016x}" and out[8][0][0] == f"{plain('one two'):016x}"
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 7, 8, 9]
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.keep_one(docs.limit(0)).collect() == []
    assert [r.component_id for r in simhash.near_duplicates(docs.where("doc_id IS NULL")).collect()] == [None]
