"""The driver's tables as transactions and references: fixtures for queries and benchmarks, not operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import MCC_RISK
from ..functions.moments import iso_minutes
from ..functions.numbers import quantize

#: Queries of the searches are the rows whose id this divides; all rows are references, the queries' own among them.
EVERY = 20
#: Of the bodies that are scored, those whose id this divides are broken.
BROKEN = 80
CODES = (*MCC_RISK, "1111", "9999")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def payload_fields(ev: DataFrame) -> DataFrame:
    """A transaction's fields for each event."""
    k, eid, uid = F.get_json_object("props", "$.k").cast("long"), F.col("event_id"), F.col("user_id")
    online = F.col("event_type").isin("click", "purchase", "signup")
    last = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts"))
    text = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    known = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")), lambda i: F.concat(F.lit("M"), ((uid + i) % 40).cast("string")))
    return ev.select(
        "event_id", F.col("value").cast("float").alias("amount"), (1 + k % 12).alias("installments"), text(F.col("ts")).alias("requested_at"), text(last).alias("last_at"),
        F.when(last.isNotNull(), k * 7.5).cast("float").alias("km_current"), (20 + uid % 60).cast("float").alias("avg_amount"), (10 + k * 5).cast("float").alias("merchant_avg"), (1 + eid % 20).alias("tx_count"),
        F.concat(F.lit("M"), (eid % 40).cast("string")).alias("merchant_id"), known.alias("known"), F.element_at(F.array(*[F.lit(c) for c in CODES]), (eid % 12 + 1).cast("int")).alias("mcc"),
        online.alias("is_online"), (~online & (k % 4 != 0)).alias("card_present"), (F.col("value") * 3).cast("float").alias("km_home"), F.when((F.col("event_type") == "error") | (F.col("value") > 100), 1).otherwise(0).alias("label"),
    )


def payload_bodies(ev: DataFrame) -> DataFrame:
    """(qid, body, label): the fields as JSON."""
    f = payload_fields(ev)
    body = F.to_json(
        F.struct(
            F.concat(F.lit("tx-"), F.col("event_id").cast("string")).alias("id"), F.struct("amount", "installments", "requested_at").alias("transaction"),
            F.struct(F.col("avg_amount"), F.col("tx_count").alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
            F.struct(F.col("merchant_id").alias("id"), "mcc", F.col("merchant_avg").alias("avg_amount")).alias("merchant"), F.struct("is_online", "card_present", F.col("km_home").alias("km_from_home")).alias("terminal"),
            F.when(F.col("last_at").isNotNull(), F.struct(F.col("last_at").alias("timestamp"), F.col("km_current").alias("km_from_current"))).alias("last_transaction"),
        )
    )
    return f.select(F.col("event_id").alias("qid"), body.alias("body"), "label")


#: Ways in which a body can be broken: SQL over its JSON text.
BREAKS = (
    "regexp_replace(body, '\"terminal\":\\\\{[^}]*\\\\}', '\"terminal\":null')", "replace(body, '\"is_online\":', '\"is_online\":1,\"was_online\":')", "replace(body, '\"installments\":', '\"installments\":-')",
    "regexp_replace(body, '\"tx_count_24h\":[0-9]+', '\"tx_count_24h\":4294967296')", "regexp_replace(body, '\"km_from_home\":[0-9.E-]+', '\"km_from_home\":NaN')", "regexp_replace(body, '\"requested_at\":\"[^\"]*\"', '\"requested_at\":\"yesterday\"')",
    "substring(body, 1, length(body) - 1)", "replace(body, '\"mcc\":\"', '\"mcc\":\"x')", "concat('[', body, ']')", "CAST(NULL AS string)", "''", "regexp_replace(body, '\"known_merchants\":\\\\[[^]]*\\\\]', '\"known_merchants\":null')",
)


def broken(bodies: DataFrame, which: Column) -> DataFrame:
    """``bodies`` with those that ``which`` numbers from 0 broken in that way (modulo their number); null: as they are."""
    ways = F.when(which.isNull(), F.col("body"))
    for k, way in enumerate(BREAKS):
        ways = ways.when(F.pmod(which, F.lit(len(BREAKS))) == k, F.expr(way))
    return bodies.withColumn("body", ways)


def event_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, label, valid, RAW..., v0..v13, part_key) without a detour over JSON."""
    from ..functions.moments import hour_of, minutes_since, weekday_of
    from ..functions.numbers import parse_digits, to_milli
    from ..functions.vectors import RAW, mcc_slot, partition_key, vectorize
    from ..operators.payload import risk_lookup
    from ..sources.references import default_mcc_risk

    f = payload_fields(events(spark, sf_dir))
    now, last, c = iso_minutes(F.col("requested_at")), iso_minutes(F.col("last_at")), F.col
    raw = f.select(
        "event_id", "label", now.alias("now"), last.alias("last"), to_milli(c("amount")).alias("amount_milli"), "installments", to_milli(c("avg_amount")).alias("avg_milli"), to_milli(c("km_current")).alias("km_last_milli"),
        to_milli(c("km_home")).alias("km_home_milli"), "tx_count", "is_online", "card_present", (~F.array_contains("known", c("merchant_id"))).alias("unknown_merchant"), to_milli(c("merchant_avg")).alias("merchant_avg_milli"), mcc_slot(parse_digits(c("mcc"))).alias("slot"),
    ).withColumns({"hour": hour_of(c("now")), "weekday": weekday_of(c("now")), "minutes_since": minutes_since(c("now"), c("last"))})
    raw = risk_lookup(raw, default_mcc_risk(spark))
    return raw.select("event_id", "label", *RAW, *vectorize()).withColumn("part_key", partition_key())


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries with qid, references with ref_id) of event vectors."""
    return rows.where(F.col("event_id") % EVERY == 0).withColumnRenamed("event_id", "qid"), rows.withColumnRenamed("event_id", "ref_id")


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, v0..v13, label): the first 14 components, quantized; label 1 where the class divides by 4."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", *[quantize(F.col("embedding")[i].cast("float")).alias(f"v{i}") for i in range(14)], F.when(F.col("label") % 4 == 0, 1).otherwise(0).alias("label"))
