"""WARC: exact round trip, digests, revisits, deterministic files, edge cases."""

import base64
import collections
import gzip
import hashlib
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ballotline.llm import warc
from ballotline.llm.common import new_path

DATA = "/root/testdata/sf0.01"


def checked(rows, pages):
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = collections.Counter((p.page_id, len((p.html or "").encode()), sha(p.html)) for p in pages)
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in rows) == want
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.payload_digest].append(r)
    for g in groups.values():
        top = max((r.page_id for r in g if r.page_id is not None), default=None)
        assert [r.page_id for r in g if r.record_type == "response"] == [top]
        assert all(r.refers_to == (None if r.record_type == "response" else top) for r in g)


def files(root):
    base = root.removeprefix("file://")
    return {f: open(f"{base}/{f}", "rb").read() for f in sorted(os.listdir(base)) if f.endswith(".gz")}


def test_whole_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    checked(warc.round_trip(pages).collect(), pages.collect())


def test_files_are_deterministic_and_roll(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    roots = [new_path(spark, "w") for _ in range(2)]
    manifest = warc.write(pages, roots[0], shard_bytes=200_000, roll_bytes=20_000).collect()
    warc.write(pages.repartition(5), roots[1], shard_bytes=200_000, roll_bytes=20_000)
    a, b = map(files, roots)
    assert a == b and len(a) == len(manifest) > 10
    assert {m.name: (m.bytes, m.sha1) for m in manifest} == {k: (len(v), hashlib.sha1(v).hexdigest()) for k, v in a.items()}
    assert all(m.bytes < 60_000 for m in manifest)
    first = [m.first_page for m in sorted(manifest, key=lambda m: m.name)]
    assert first == sorted(first)
    raw = gzip.decompress(next(iter(a.values())))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ")
    back = {r.page_id: r.payload for r in warc.read(spark, roots[0], payloads=True).collect() if r.record_type == "response"}
    assert back == {p.page_id: p.html for p in pages.collect() if p.page_id in back}


def test_edges(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (3, "u\nv", "x", 1), (3, "w", "x", 1), (3, "w", "x", None), (None, "n", "x", 1), (None, "n", "ü" * 100_000, 1), (9, "u", "x", 1), (4, "u", "a\r\n\r\nb", 1), (-5, "u", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, shard int")
    out = warc.round_trip(pages).collect()
    checked(out, pages.collect())
    assert warc.round_trip(pages.limit(0)).collect() == []
    checked(warc.round_trip(pages.where("page_id IS NULL")).collect(), pages.where("page_id IS NULL").collect())


def test_very_many_shards(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    total = sum(len((p.html or "").encode()) for p in pages.collect())
    root = new_path(spark, "w")
    manifest = warc.write(pages, root, shard_bytes=total // 10_000).collect()
    assert max(m.shard for m in manifest) > 9_900 and len(manifest) > 0.8 * pages.count()
    checked(warc.read(spark, root).drop("url").collect(), pages.collect())


def test_shards_of_ids_in_clusters(spark):
    ids = [-(1 << 63), -7, *range(500), *range(1 << 40, (1 << 40) + 300), *range((1 << 62) + 1, (1 << 62) + 3000, 7), (1 << 63) - 1]
    held = spark.createDataFrame([(i, 1000) for i in ids] + [(None, 1000)] * 40 + [(250, 1000)] * 200, "page_id long, bytes long").withColumn("sha1", F.unhex(F.sha1(F.monotonically_increasing_id().cast("string"))))
    n = len(ids) + 240
    total, cells = warc._cells(held)
    assert total == 1000 * n and sum(b for *_, b in cells) == total and cells[0] == (0, 0, 0, 40_000)
    assert sorted(b for *_, b in cells)[-3:] == [1000, 40_000, 201_000]  # every id of its own, as each is heavy here
    rows = sorted((r.page_id is not None, r.page_id or 0, bytes(r.sha1), r.shard) for r in warc._sharded(held, cells, 50, -(-total // 50)).collect())
    per = Counter(r[3] for r in rows)
    assert [r[3] for r in rows] == sorted(r[3] for r in rows) and len(per) == 50 and max(per.values()) <= 2 * n / 50


def test_damage_is_seen(spark):
    root = new_path(spark, "w")
    warc.write(spark.read.parquet(f"{DATA}/pages.parquet").limit(20), root)
    name = f"{root.removeprefix('file://')}/{next(iter(files(root)))}"
    data = gzip.decompress(open(name, "rb").read()).replace(b"<p", b"<q", 1)
    with open(name, "wb") as f:
        f.write(gzip.compress(data))
    with pytest.raises(Exception, match="damaged|not a WARC|ends within"):
        warc.read(spark, root).collect()
