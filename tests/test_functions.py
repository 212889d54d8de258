"""Scalar functions against golden values and exact Python arithmetic."""

import math
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ballotline.constants import DIMS, VECTOR
from ballotline.functions import moments, numbers, vectors
from ballotline.operators import partitions
from ballotline.sources.references import risk_table


def values(spark, rows, kind, *cols):
    """Each expression over single values."""
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}").orderBy("k")
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]


def test_to_milli(spark):
    assert values(spark, [0.0, 1.5, 41.12, -3.0, 20000.126, 1e30, float("inf"), None, 0.0005], "double", numbers.to_milli(F.col("x"))) == [0, 1500, 41120, 0, 20000127, 4294967295, 4294967295, None, 1]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.floats(0, 1e6, width=32), min_size=300, max_size=300))
def test_to_milli_is_half_away_from_zero(spark, xs):
    want = [min(int(math.floor(float(np.float32(x)) * 1000 + 0.5)), 4294967295) for x in xs]
    got = values(spark, xs, "double", numbers.to_milli(F.col("x")))
    assert all(abs(a - b) <= (1 if float(np.float32(x)) * 1000 % 1 in (0.5, 0.49999999999999994) else 0) for a, b, x in zip(got, want, xs))


def test_parse_digits(spark):
    rows = ["", "0", "5411", "4294967295", "4294967296", "00000000000000000000017", "12a", "-1", " 1", "1\n", "99999999999999999999", None, "٣"]
    assert values(spark, rows, "string", numbers.parse_digits(F.col("x"))) == [0, 0, 5411, 4294967295, None, 17, None, None, None, None, None, None, None]


def test_divisions(spark):
    rows = list(range(0, 30_000, 7))
    got = values(spark, rows, "long", numbers.rounded_div(F.col("x"), 7), numbers.scaled(F.col("x"), 12), numbers.scaled_milli(F.col("x"), 3))
    assert got == [((x + 3) // 7, min((x * 10000 + 6) // 12, 10000), min((x * 10000 + 1500) // 3000, 10000)) for x in rows]
    assert values(spark, [4294967295, None], "long", numbers.scaled_milli(F.col("x"), 10000)) == [10000, None]


def test_amount_ratio(spark):
    df = spark.createDataFrame([(41120, 82240), (5, 0), (0, 7), (4294967295, 1), (10, 4000)], "a long, b long")
    assert [r[0] for r in df.select(numbers.amount_ratio(F.col("a"), F.col("b"))).collect()] == [500, 10000, 0, 10000, 3]


def test_quantize(spark):
    assert values(spark, [-1.0, -7.0, -0.5, 0.0, 0.5, 1.0, 3.0, 0.8261], "float", numbers.quantize(F.col("x"))) == [-10000, -10000, 0, 0, 5000, 10000, 10000, 8261]


def test_times(spark):
    day = lambda y, m, d: (date(y, m, d) - date(1970, 1, 1)).days * 1440
    rows = ["2026-03-11T18:45:53Z", "2026-02-31T00:00:00Z", "2026-03-03T00:00:00+05:00", "1970-01-01T00:00:00", "1969-12-31x23?59!59", "2024-02-30T10:00:00Z"]
    want = [day(2026, 3, 11) + 18 * 60 + 45, day(2026, 3, 3), day(2026, 3, 3), 0, -1, day(2024, 3, 1) + 600]
    assert values(spark, rows, "string", moments.iso_minutes(F.col("x"))) == want
    bad = ["", None, "2026-03-11", "2026-13-11T18:45:53Z", "2026-00-11T18:45:53Z", "2026-03-32T18:45:53Z", "2026-03-00T18:45:53Z", "2026-03-11T24:45:53Z", "2026-03-11T18:60:53Z", "2o26-03-11T18:45:53Z", "2026-03-11T18:45:5"]
    assert values(spark, bad, "string", moments.iso_minutes(F.col("x"))) == [None] * len(bad)
    m = moments.iso_minutes(F.col("x"))
    assert values(spark, ["2026-03-11T18:45:53Z", "1969-12-31T23:59:59Z", "2026-03-16T00:00:00Z"], "string", moments.hour_of(m), moments.weekday_of(m)) == [(18, 2), (23, 2), (0, 0)]


def test_minutes_since(spark):
    df = spark.createDataFrame([("2026-01-01T00:01:01Z", "2026-01-01T00:00:59Z"), ("2026-01-01T20:00:00Z", "2026-01-01T18:00:00Z"), ("2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z"), ("2026-01-01T00:00:00Z", None)], "a string, b string")
    assert [r[0] for r in df.select(moments.minutes_since(moments.iso_minutes(F.col("a")), moments.iso_minutes(F.col("b")))).collect()] == [1, 120, 0, None]


def test_partition_key(spark):
    zero, none = dict.fromkeys(VECTOR, 0), dict.fromkeys(VECTOR, 0) | {"v5": -10000}
    full = dict.fromkeys(VECTOR, 10000)
    df = spark.createDataFrame([tuple(d[v] for v in VECTOR) for d in (zero, none, full)], ", ".join(f"{v} int" for v in VECTOR))
    assert [r[0] for r in df.select(vectors.partition_key()).collect()] == [1, 0, 255]


def test_bounds(spark):
    row = [300] * DIMS + [50] * DIMS + [200] * DIMS
    cols = ", ".join([f"v{i} int" for i in range(DIMS)] + [f"lo{i} int" for i in range(DIMS)] + [f"hi{i} int" for i in range(DIMS)])
    df = spark.createDataFrame([tuple(row), tuple([100] * DIMS + row[DIMS:])], cols)
    assert [r[0] for r in df.select(vectors.lower_bound()).collect()] == [140000, 0]
    assert [r[0] for r in df.select(vectors.widest_dim()).collect()] == [0, 0]


def test_risks_share_slots(spark):
    raw = spark.createDataFrame([("5411", 0.15), ("1315", 0.3), ("abc", 0.9), ("-5", 0.9), ("", 0.9)], "code string, risk float")
    assert [tuple(r) for r in risk_table(raw).collect()] == [(291, 1500)]


def test_leaves_split_everything(spark):
    same = spark.range(700).select(F.col("id").alias("ref_id"), *[F.lit(3).alias(v) for v in VECTOR], F.lit(0).alias("label"), F.lit(9).alias("part_key"))
    other = spark.range(700, 1500).select(F.col("id").alias("ref_id"), *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(4)).cast("int").alias(v) for i, v in enumerate(VECTOR)], F.lit(0).alias("label"), F.lit(2).alias("part_key"))
    n = partitions.with_leaves(same.union(other), 64)[1].collect()
    assert sum(r.n for r in n) == 1500 and max(r.n for r in n) <= 64


@pytest.mark.parametrize("size", [1, 5000])
def test_leaf_sizes_are_limited(spark, size):
    rows = spark.range(3000).select(F.col("id").alias("ref_id"), *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100)).cast("int").alias(v) for i, v in enumerate(VECTOR)], F.lit(0).alias("label"), F.lit(1).alias("part_key"))
    n = [r.n for r in partitions.with_leaves(rows, size)[1].collect()]
    assert max(n) <= (32 if size == 1 else 2048)


def test_leaves_from_a_sample(spark, monkeypatch):
    monkeypatch.setattr(partitions, "SAMPLE_ROWS", 400)
    rows = spark.range(6000).select(F.col("id").alias("ref_id"), *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)).cast("int").alias(v) for i, v in enumerate(VECTOR)], F.lit(0).alias("label"), F.pmod(F.col("id"), F.lit(3)).cast("int").alias("part_key"))
    at, held = partitions.with_leaves(rows, 64)
    assert sum(r.n for r in held.collect()) == 6000 == at.select("ref_id").distinct().count() and max(r.n for r in held.collect()) <= 64
