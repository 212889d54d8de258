"""Transactions from JSON bodies: parsing with fail-open rules, and the raw features.

A body is valid if it is an object whose known fields have their types. What is
missing has a default (0, false, ''); an explicit null, a wrong type, a negative or
too large count, NaN, or a request without a readable time or code makes it invalid.
Invalid bodies stay, marked by ``valid``: they are approved with score 0 later.
Malformed JSON (trailing commas, a missing last brace) is invalid too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PAYLOAD_SCHEMA, U32_MAX
from ..functions.moments import hour_of, iso_minutes, minutes_since, weekday_of
from ..functions.numbers import parse_digits, to_milli
from ..functions.vectors import RAW, mcc_slot, partition_key, vectorize

_SECTIONS = ("transaction", "customer", "merchant", "terminal")
_STRINGS = ("transaction.requested_at", "merchant.id", "merchant.mcc", "last_transaction.timestamp")
_COUNTS = ("transaction.installments", "customer.tx_count_24h")
_FLOATS = ("transaction.amount", "customer.avg_amount", "merchant.avg_amount", "terminal.km_from_home", "last_transaction.km_from_current")
_FLAGS = ("terminal.is_online", "terminal.card_present")


def extract(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``p``, the parsed struct, and ``readable``: whether every known field has its type and range."""
    schema = f"{PAYLOAD_SCHEMA}, _corrupt_record STRING"
    held = bodies.withColumn("p", F.from_json(F.col(body), schema)).withColumn("__v", F.try_parse_json(F.col(body)))
    # a variant tells null from missing and a number from a text; bodies with repeated keys have none and skip these tests
    kind = lambda path: F.schema_of_variant(F.try_variant_get(F.col("__v"), f"$.{path}", "variant"))
    field = lambda path: F.col(f"p.{path}")
    sure = lambda x: F.coalesce(x, F.lit(False))
    bad = [F.col("p").isNull() | F.col("p._corrupt_record").isNotNull(), ~sure(F.ltrim(F.col(body)).startswith("{"))]
    bad += [sure(kind(x) == "VOID") for x in (*_SECTIONS, *_COUNTS, *_FLOATS, *_FLAGS, "customer.known_merchants")]
    bad += [sure(kind(x) != "STRING") for x in _STRINGS]
    bad += [sure(~field(x).between(0, U32_MAX)) for x in _COUNTS]
    bad += [sure(F.isnan(field(x))) for x in _FLOATS]
    return held.withColumn("readable", ~reduce(lambda a, b: a | b, bad)).drop("__v")


def raw_features(parsed: DataFrame, mcc_risk: DataFrame) -> DataFrame:
    """The columns of RAW and ``valid`` beside the others; ``p`` and ``readable`` go. ``mcc_risk``: (slot, mcc_risk_q), at most 1,024 rows."""
    f = lambda path, default: F.coalesce(F.col(f"p.{path}"), F.lit(default))
    now, code = iso_minutes(f("transaction.requested_at", "")), parse_digits(f("merchant.mcc", ""))
    known = F.coalesce(F.array_contains(F.col("p.customer.known_merchants"), f("merchant.id", "")), F.lit(False))
    rest = [c for c in parsed.columns if c not in ("p", "readable")]
    milli = lambda path: to_milli(f(path, 0.0))
    held = parsed.select(
        *rest, (F.col("readable") & now.isNotNull() & code.isNotNull()).alias("valid"), F.coalesce(now, F.lit(0)).alias("__now"), mcc_slot(F.coalesce(code, F.lit(0))).alias("slot"),
        milli("transaction.amount").alias("amount_milli"), f("transaction.installments", 0).alias("installments"), milli("customer.avg_amount").alias("avg_milli"),
        iso_minutes(F.col("p.last_transaction.timestamp")).alias("__last"), to_milli(F.col("p.last_transaction.km_from_current")).alias("km_last_milli"), milli("terminal.km_from_home").alias("km_home_milli"),
        f("customer.tx_count_24h", 0).alias("tx_count"), f("terminal.is_online", False).alias("is_online"), f("terminal.card_present", False).alias("card_present"), (~known).alias("unknown_merchant"), milli("merchant.avg_amount").alias("merchant_avg_milli"),
    )
    held = held.withColumns({"hour": hour_of(F.col("__now")), "weekday": weekday_of(F.col("__now")), "minutes_since": minutes_since(F.col("__now"), F.col("__last"))})
    return risk_lookup(held, mcc_risk).select(*rest, "valid", *RAW)


def risk_lookup(rows: DataFrame, mcc_risk: DataFrame) -> DataFrame:
    """Adds mcc_risk_q of each row's ``slot``; 0 for slots without a code. The table has 1,024 rows at most, so it is broadcast."""
    return rows.join(F.broadcast(mcc_risk), "slot", "left").withColumn("mcc_risk_q", F.coalesce("mcc_risk_q", F.lit(0)).cast("int"))


def vectors(raw: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, v0 to v13 and part_key."""
    return raw.select(*keep, *vectorize()).withColumn("part_key", partition_key())


