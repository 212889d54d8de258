"""The 14 features, the partition key, distances and bounds, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DIMS, MAX_AMOUNT, MAX_INSTALLMENTS, MAX_KM, MAX_MERCHANT_AVG, MAX_MINUTES, MAX_TX_24H, MCC_SLOTS, SCALE, VECTOR
from .numbers import amount_ratio, clamp, rounded_div, scaled, scaled_milli

#: The columns that ``vectorize`` reads.
RAW = (
    "amount_milli", "installments", "avg_milli", "hour", "weekday", "minutes_since", "km_last_milli", "km_home_milli", "tx_count", "is_online", "card_present", "unknown_merchant", "mcc_risk_q", "merchant_avg_milli",
)


def vectorize() -> list[Column]:
    """v0 to v13 from the columns of RAW. Without a last transaction v5 and v6 are -SCALE, each by itself."""
    c = F.col
    flag = lambda x: F.when(x, SCALE).otherwise(0)
    or_none = lambda x, n: F.when(x.isNull(), -SCALE).otherwise(n)
    dims = [
        scaled_milli(c("amount_milli"), MAX_AMOUNT), scaled(c("installments"), MAX_INSTALLMENTS), amount_ratio(c("amount_milli"), c("avg_milli")), clamp(rounded_div(c("hour").cast("long") * SCALE, 23)), clamp(rounded_div(c("weekday").cast("long") * SCALE, 6)),
        or_none(c("minutes_since"), scaled(c("minutes_since"), MAX_MINUTES)), or_none(c("km_last_milli"), scaled_milli(c("km_last_milli"), MAX_KM)), scaled_milli(c("km_home_milli"), MAX_KM), scaled(c("tx_count"), MAX_TX_24H),
        flag(c("is_online")), flag(c("card_present")), flag(c("unknown_merchant")), c("mcc_risk_q"), scaled_milli(c("merchant_avg_milli"), MAX_MERCHANT_AVG),
    ]
    return [d.cast("int").alias(v) for d, v in zip(dims, VECTOR)]


def mcc_slot(mcc: Column) -> Column:
    return F.pmod(mcc, F.lit(MCC_SLOTS)).cast("int")


def partition_key(v: tuple[str, ...] = VECTOR) -> Column:
    """Eight bits of what tells references apart most: a last transaction, flags, risk, ratio, count."""
    c = [F.col(x) for x in v]
    bit = lambda x, n: F.when(x, 1 << n).otherwise(0)
    risk = F.when(c[12] <= 2047, 0).when(c[12] <= 4095, 1).when(c[12] <= 6143, 2).otherwise(3)
    bits = [bit(c[5] >= 0, 0), bit(c[9] > 0, 1), bit(c[10] > 0, 2), bit(c[11] > 0, 3), risk * 16, bit(c[2] > 4096, 6), bit(c[8] > 2048, 7)]
    return reduce(lambda a, b: a + b, bits).cast("int")


def squared_distance(a: str = "", b: str = "r_") -> Column:
    """Sum of squared differences of the columns {a}v0.. and {b}v0.., unrolled and in BIGINT."""
    parts = [F.col(f"{a}{v}").cast("long") - F.col(f"{b}{v}").cast("long") for v in VECTOR]
    return reduce(lambda x, y: x + y, [d * d for d in parts])


def gap(q: Column, lo: Column, hi: Column) -> Column:
    """How far a value lies outside of [lo, hi]; none of them is null."""
    return F.greatest(lo.cast("long") - q, q.cast("long") - hi, F.lit(0).cast("long"))


def lower_bound(q: str = "", box: str = "") -> Column:
    """The least squared distance from {q}v0.. to any point of the box {box}lo0.., {box}hi0.. ."""
    gaps = [gap(F.col(f"{q}v{i}"), F.col(f"{box}lo{i}"), F.col(f"{box}hi{i}")) for i in range(DIMS)]
    return reduce(lambda x, y: x + y, [g * g for g in gaps])


def widest_dim(box: str = "") -> Column:
    """The dimension with the largest hi - lo; of equal ones the first."""
    spans = [F.col(f"{box}hi{i}") - F.col(f"{box}lo{i}") for i in range(DIMS)]
    most = F.greatest(*spans)
    return reduce(lambda otherwise, i: F.when(spans[i] == most, i).otherwise(otherwise), range(DIMS - 1, -1, -1), F.lit(0)).cast("int")
