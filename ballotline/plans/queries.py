"""Queries over the driver's tables for every operator, with DuckDB SQL of its own for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DIMS, LEAF_SIZE, MCC_RISK, SCALE, VECTOR
from ..functions import moments, numbers
from ..functions.vectors import lower_bound, mcc_slot, partition_key, squared_distance, widest_dim
from ..operators import knn, partitions
from ..operators.payload import extract, raw_features, risk_lookup, vectors
from ..operators.tables import Written, new_path
from ..operators.vote import decide, response, vote
from ..sources.index import build_index, read_index, write_index
from ..sources.references import default_mcc_risk, load_mcc_risk, load_references, quantize_references
from . import bindings as b
from .scoring import score as score_bodies

Query = Callable[[SparkSession, str], DataFrame]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.event_vectors(spark, sf_dir)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and references, computed once and written. Adaptive execution would leave small tables in one file, and so one task."""
    rows = Written(_vectors(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "event_id"), "event-vectors").df
    return b.split(rows)


def to_milli(spark, sf_dir):
    f = b.payload_fields(b.events(spark, sf_dir))
    return f.select("event_id", numbers.to_milli(F.col("amount")).alias("amount_milli"), numbers.to_milli(F.col("km_home")).alias("km_home_milli"), numbers.to_milli(F.col("km_current")).alias("km_last_milli"))


def iso_minutes(spark, sf_dir):
    f = b.payload_fields(b.events(spark, sf_dir))
    return f.select("event_id", moments.iso_minutes(F.col("requested_at")).alias("minutes"), moments.iso_minutes(F.col("last_at")).alias("last_minutes"))


def hour_dow(spark, sf_dir):
    m = iso_minutes(spark, sf_dir)
    return m.select("event_id", moments.hour_of(F.col("minutes")).alias("hour"), moments.weekday_of(F.col("minutes")).alias("weekday"))


def minutes_since(spark, sf_dir):
    return iso_minutes(spark, sf_dir).select("event_id", moments.minutes_since(F.col("minutes"), F.col("last_minutes")).alias("minutes_since"))


def unknown_merchant(spark, sf_dir):
    f = b.payload_fields(b.events(spark, sf_dir))
    return f.select("event_id", (~F.array_contains("known", F.col("merchant_id"))).alias("unknown_merchant"))


def mcc_risk_lookup(spark, sf_dir):
    f = b.payload_fields(b.events(spark, sf_dir)).select("event_id", mcc_slot(numbers.parse_digits(F.col("mcc"))).alias("slot"))
    return risk_lookup(f, default_mcc_risk(spark)).select("event_id", F.col("slot"), "mcc_risk_q")


def quantize_div(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = F.col("l_quantity").cast("long")
    return o.select("l_orderkey", "l_linenumber", numbers.rounded_div(q * 1000, 7).alias("rounded"), numbers.scaled(q, 12).alias("scaled"), numbers.scaled_milli(F.col("l_extendedprice").cast("long"), 100).alias("scaled_milli"))


def amount_ratio(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return o.select("l_orderkey", "l_linenumber", numbers.amount_ratio(F.col("l_extendedprice").cast("long"), (F.col("l_partkey") % 50 * 100).cast("long")).alias("ratio"))


def vectorize_events(spark, sf_dir):
    return _vectors(spark, sf_dir).select("event_id", *VECTOR)


def partition_key_events(spark, sf_dir):
    return _vectors(spark, sf_dir).select("event_id", "part_key")


def ref_quantize(spark, sf_dir):
    return b.embedding_vectors(spark, sf_dir)


def ref_partition_hist(spark, sf_dir):
    _, refs = b.split(_vectors(spark, sf_dir))
    return partitions.histogram(refs)


def part_bbox(spark, sf_dir):
    _, refs = b.split(_vectors(spark, sf_dir))
    return partitions.boxes(refs, "part_key")


def partition_widest_dim(spark, sf_dir):
    return part_bbox(spark, sf_dir).select("part_key", widest_dim().alias("dim"))


def median_split(spark, sf_dir):
    _, refs = _split(spark, sf_dir)
    return partitions.median_split(refs).select("ref_id", "part_key", "dim", "side")


def index_leaves(spark, sf_dir):
    """What holds for any tree, by partition: its leaves have all rows, their boxes make up its box, none is too large."""
    _, refs = _split(spark, sf_dir)
    leaves = partitions.boxes(build_index(refs).refs, "part_key", "leaf_id")
    sides = [F.min(f"lo{i}").alias(f"lo{i}") for i in range(DIMS)] + [F.max(f"hi{i}").alias(f"hi{i}") for i in range(DIMS)]
    return leaves.groupBy("part_key").agg(F.sum("n").alias("n"), *sides, (F.max("n") <= LEAF_SIZE).alias("leaves_fit"), (F.count("*") >= F.ceil(F.sum("n") / LEAF_SIZE)).alias("leaves_enough"))


def reference_files(spark, sf_dir):
    """References written as gzipped JSON arrays, read back and quantized; equal ones are counted."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = F.to_json(F.struct(F.col("embedding").cast("array<float>").alias("vector"), F.when(F.col("label") % 4 == 0, "fraud").otherwise("legit").alias("label")))
    files = e.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ",\n"), F.lit("]")).alias("value"))
    path = new_path(spark, "reference-files")
    files.repartition("file").write.partitionBy("file").option("compression", "gzip").text(path)
    held = load_references(spark, path)
    return quantize_references(held).groupBy(*VECTOR, "label").agg(F.count("*").alias("n"))


def risk_files(spark, sf_dir):
    """A risk map written as JSON with keys that are no numbers and codes that share slots, read back."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    rows = s.select((F.col("s_suppkey") * 37).cast("string").alias("code"), (F.pmod(F.col("s_suppkey"), F.lit(1000)) / 1000).cast("float").alias("risk"))
    rows = rows.union(s.select(F.concat(F.lit("x"), F.col("s_suppkey").cast("string")), F.lit(0.5).cast("float")))
    path = new_path(spark, "risk-files")
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("code", "risk")))).alias("value")).write.text(path)
    return load_mcc_risk(spark, path)


def json_broken_bodies(spark, sf_dir):
    """Every body broken in one way or, of thirteen, left whole: which are valid."""
    k = F.col("qid") % (len(b.BREAKS) + 1)
    bodies = b.broken(b.payload_bodies(b.events(spark, sf_dir)), F.when(k > 0, k - 1))
    raw = raw_features(extract(bodies), default_mcc_risk(spark))
    return raw.select(F.col("qid").alias("event_id"), "valid")


def index_counts(spark, sf_dir):
    _, refs = b.split(_vectors(spark, sf_dir))
    return refs.agg(F.count("*").alias("references"), F.countDistinct("part_key").alias("partitions"), F.sum("label").alias("frauds"))


def index_roundtrip(spark, sf_dir):
    _, refs = _split(spark, sf_dir)
    path = Written(spark.range(1), "index-place").path + "-index"
    write_index(build_index(refs), default_mcc_risk(spark), path)
    held, _ = read_index(spark, path)
    return partitions.histogram(held.refs)


def json_extract_props(spark, sf_dir):
    bodies = b.payload_bodies(b.events(spark, sf_dir))
    p = extract(bodies)
    return p.select(F.col("qid").alias("event_id"), "readable", F.col("p.transaction.installments").alias("installments"), F.col("p.customer.tx_count_24h").alias("tx_count"), F.col("p.merchant.id").alias("merchant_id"), F.col("p.merchant.mcc").alias("mcc"), F.col("p.terminal.is_online").alias("is_online"), F.col("p.last_transaction.timestamp").alias("last_at"))


def json_payload_vectors(spark, sf_dir):
    raw = raw_features(extract(b.payload_bodies(b.events(spark, sf_dir))), default_mcc_risk(spark))
    return vectors(raw.where("valid"), ("qid",)).select(F.col("qid").alias("event_id"), *VECTOR)


def json_payload_scores(spark, sf_dir):
    ev = b.events(spark, sf_dir)
    _, refs = _split(spark, sf_dir)
    bodies = b.broken(b.payload_bodies(ev).where(F.col("qid") % b.EVERY == 0), F.when(F.col("qid") % b.BROKEN == 0, F.col("qid") / b.BROKEN).cast("long"))
    return score_bodies(bodies, build_index(refs), default_mcc_risk(spark)).select("qid", "valid", "fraud_count", "approved", "fraud_score")


def _centre() -> list:
    return [F.lit(SCALE // 2).alias(f"r_{v}") for v in VECTOR]


def l2_distance(spark, sf_dir):
    return _vectors(spark, sf_dir).select("event_id", *VECTOR, *_centre()).select("event_id", squared_distance().alias("d2"))


def part_lower_bound(spark, sf_dir):
    q, refs = _split(spark, sf_dir)
    parts = partitions.boxes(refs, "part_key").withColumnRenamed("part_key", "target")
    return q.join(F.broadcast(parts)).select("qid", "target", lower_bound().alias("lb"))


def knn_top5(spark, sf_dir):
    q, refs = _split(spark, sf_dir)
    return knn.nearest(q, refs)


def knn_vote(spark, sf_dir):
    q, refs = _split(spark, sf_dir)
    return decide(q.select("qid"), vote(knn.nearest(q, refs))).select("qid", "fraud_count")


def knn_pruned_top5(spark, sf_dir):
    q, refs = _split(spark, sf_dir)
    return knn.pruned(q, build_index(refs))


def knn_pruned_vote(spark, sf_dir):
    q, refs = _split(spark, sf_dir)
    return decide(q.select("qid"), vote(knn.pruned(q, build_index(refs)))).select("qid", "fraud_count")


def fraud_decision(spark, sf_dir):
    q, refs = _split(spark, sf_dir)
    out = response(decide(q.select("qid"), vote(knn.pruned(q, build_index(refs)))))
    return out.select("qid", "fraud_count", "approved", "fraud_score", "response")


def knn_embeddings(spark, sf_dir):
    rows = Written(b.embedding_vectors(spark, sf_dir), "embedding-vectors").df
    q = rows.where(F.col("vec_id") % b.EVERY == 0).withColumnRenamed("vec_id", "qid").withColumn("part_key", partition_key())
    return knn.pruned(q, build_index(rows.withColumnRenamed("vec_id", "ref_id")))


def queries() -> dict[str, Query]:
    names = [
        to_milli, iso_minutes, hour_dow, minutes_since, unknown_merchant, mcc_risk_lookup, quantize_div, amount_ratio, vectorize_events, partition_key_events, ref_quantize, ref_partition_hist, part_bbox, partition_widest_dim, median_split,
        index_leaves, index_counts, index_roundtrip, reference_files, risk_files, json_extract_props, json_payload_vectors, json_broken_bodies, json_payload_scores, l2_distance, part_lower_bound, knn_top5, knn_vote, knn_pruned_top5, knn_pruned_vote, fraud_decision, knn_embeddings,
    ]
    return {f.__name__: f for f in names}


# DuckDB ------------------------------------------------------------------------

_CODES = ", ".join(f"'{c}'" for c in b.CODES)
_RISKS = ", ".join(f"({int(c) % 1024}, {round(r * SCALE)})" for c, r in MCC_RISK.items())
_MILLI = "CASE WHEN {x} IS NULL THEN NULL ELSE CAST(greatest(round(CAST({x} AS DOUBLE) * 1000), 0) AS BIGINT) END"
_FIELDS = f"""
k AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS last_ts, event_type IN ('click', 'purchase', 'signup') AS is_online FROM events),
f AS (SELECT event_id, CAST(value AS FLOAT) AS amount, 1 + k % 12 AS installments, ts, last_ts, CASE WHEN last_ts IS NULL THEN NULL ELSE CAST(k * 7.5 AS FLOAT) END AS km_current,
  CAST(20 + user_id % 60 AS FLOAT) AS avg_amount, CAST(10 + k * 5 AS FLOAT) AS merchant_avg, 1 + event_id % 20 AS tx_count, 'M' || CAST(event_id % 40 AS VARCHAR) AS merchant_id,
  list_transform(range(20), lambda i: 'M' || CAST((user_id + i) % 40 AS VARCHAR)) AS known, [{_CODES}][CAST(event_id % 12 + 1 AS BIGINT)] AS mcc, is_online, (NOT is_online AND k % 4 <> 0) AS card_present,
  CAST(value * 3 AS FLOAT) AS km_home, CASE WHEN event_type = 'error' OR value > 100 THEN 1 ELSE 0 END AS label FROM k),
m AS (SELECT *, CAST(floor(epoch(date_trunc('minute', ts)) / 60) AS BIGINT) AS minutes, CAST(floor(epoch(date_trunc('minute', last_ts)) / 60) AS BIGINT) AS last_minutes,
  {_MILLI.format(x="amount")} AS amount_milli, {_MILLI.format(x="km_current")} AS km_last_milli, {_MILLI.format(x="km_home")} AS km_home_milli, {_MILLI.format(x="avg_amount")} AS avg_milli, {_MILLI.format(x="merchant_avg")} AS merchant_avg_milli FROM f),
risks AS (SELECT * FROM (VALUES {_RISKS}) t(slot, q))
"""
_DIV = "least(({n} + {d} // 2) // {d}, 10000)"


def _div(n: str, d: str) -> str:
    return f"CAST({_DIV.format(n=f'CAST(CAST({n} AS BIGINT) * 10000 AS BIGINT)', d=f'CAST({d} AS BIGINT)')} AS INTEGER)"


_DIMS_SQL = [
    _div("amount_milli", "10000000"), _div("installments", "12"), "CAST(CASE WHEN avg_milli = 0 THEN 10000 ELSE least((amount_milli * 1000 + avg_milli // 2) // avg_milli, 10000) END AS INTEGER)", _div("hour(ts)", "23"), _div("isodow(ts) - 1", "6"),
    f"CASE WHEN last_minutes IS NULL THEN -10000 ELSE {_div('greatest(minutes - last_minutes, 0)', '1440')} END", f"CASE WHEN km_last_milli IS NULL THEN -10000 ELSE {_div('km_last_milli', '1000000')} END", _div("km_home_milli", "1000000"), _div("tx_count", "20"),
    "CASE WHEN is_online THEN 10000 ELSE 0 END", "CASE WHEN card_present THEN 10000 ELSE 0 END", "CASE WHEN list_contains(known, merchant_id) THEN 0 ELSE 10000 END", "CAST(coalesce(q, 0) AS INTEGER)", _div("merchant_avg_milli", "10000000"),
]
_KEY_SQL = "CAST((CASE WHEN v5 >= 0 THEN 1 ELSE 0 END) + (CASE WHEN v9 > 0 THEN 2 ELSE 0 END) + (CASE WHEN v10 > 0 THEN 4 ELSE 0 END) + (CASE WHEN v11 > 0 THEN 8 ELSE 0 END) + (CASE WHEN v12 <= 2047 THEN 0 WHEN v12 <= 4095 THEN 16 WHEN v12 <= 6143 THEN 32 ELSE 48 END) + (CASE WHEN v2 > 4096 THEN 64 ELSE 0 END) + (CASE WHEN v8 > 2048 THEN 128 ELSE 0 END) AS INTEGER)"
_V = ", ".join(VECTOR)
_VECTORS = f"""{_FIELDS}, v AS (SELECT event_id, label, {', '.join(f'{d} AS v{i}' for i, d in enumerate(_DIMS_SQL))} FROM m LEFT JOIN risks ON CAST(mcc AS BIGINT) % 1024 = slot),
e AS (SELECT *, {_KEY_SQL} AS part_key FROM v), q AS (SELECT event_id AS qid, * EXCLUDE (event_id) FROM e WHERE event_id % {b.EVERY} = 0), r AS (SELECT event_id AS ref_id, * EXCLUDE (event_id) FROM e)"""
_BOX = ", ".join(f"{f}(v{i}) AS {s}{i}" for f, s in (("min", "lo"), ("max", "hi")) for i in range(DIMS))
_L2 = " + ".join(f"CAST(q.v{i} - r.v{i} AS BIGINT) * (q.v{i} - r.v{i})" for i in range(DIMS))
_NEAR = f"{_VECTORS}, d AS (SELECT qid, ref_id, r.label AS label, {_L2} AS d2 FROM q CROSS JOIN r), n AS (SELECT qid, CAST(rank AS INTEGER) AS rank, ref_id, label, d2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, ref_id) AS rank FROM d) WHERE rank <= 5)"
_VOTE = "SELECT qid, CAST(coalesce(sum(n.label), 0) AS INTEGER) AS fraud_count FROM q LEFT JOIN n USING (qid) GROUP BY qid"
_QUANT = "CAST(CASE WHEN {x} <= -1 THEN -10000 WHEN {x} <= 0 THEN 0 WHEN {x} >= 1 THEN 10000 ELSE round(CAST({x} AS DOUBLE) * 10000) END AS INTEGER)"
_WIDEST = "CAST(CASE " + " ".join(f"WHEN hi{i} - lo{i} = greatest({', '.join(f'hi{j} - lo{j}' for j in range(DIMS))}) THEN {i}" for i in range(DIMS)) + " END AS INTEGER)"
_LB = " + ".join(f"CAST(greatest(lo{i} - v{i}, v{i} - hi{i}, 0) AS BIGINT) * greatest(lo{i} - v{i}, v{i} - hi{i}, 0)" for i in range(DIMS))
_EMB = f"SELECT vec_id, {', '.join(f'{_QUANT.format(x=f"CAST(embedding[{i + 1}] AS FLOAT)")} AS v{i}' for i in range(DIMS))}, CASE WHEN label % 4 = 0 THEN 1 ELSE 0 END AS label FROM embeddings"


def oracle_sql() -> dict[str, str]:
    hist = f"WITH {_VECTORS} SELECT part_key, count(*) AS n, CAST(sum(label) AS BIGINT) AS fraud FROM r GROUP BY part_key"
    parts = f"parts AS (SELECT part_key, count(*) AS n, {_BOX} FROM r GROUP BY part_key)"
    top = f"WITH {_NEAR} SELECT qid, rank, ref_id, label, d2 FROM n"
    count = f"WITH {_NEAR} {_VOTE}"
    return {
        "to_milli": f"WITH {_FIELDS} SELECT event_id, amount_milli, km_home_milli, km_last_milli FROM m",
        "iso_minutes": f"WITH {_FIELDS} SELECT event_id, minutes, last_minutes FROM m",
        "hour_dow": f"WITH {_FIELDS} SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday FROM m",
        "minutes_since": f"WITH {_FIELDS} SELECT event_id, CASE WHEN last_ts IS NULL THEN NULL ELSE greatest(date_diff('minute', last_ts, ts), 0) END AS minutes_since FROM m",
        "unknown_merchant": f"WITH {_FIELDS} SELECT event_id, NOT list_contains(known, merchant_id) AS unknown_merchant FROM f",
        "mcc_risk_lookup": f"WITH {_FIELDS} SELECT event_id, CAST(CAST(mcc AS BIGINT) % 1024 AS INTEGER) AS slot, CAST(coalesce(q, 0) AS INTEGER) AS mcc_risk_q FROM f LEFT JOIN risks ON CAST(mcc AS BIGINT) % 1024 = risks.slot",
        "quantize_div": "SELECT l_orderkey, l_linenumber, (CAST(l_quantity AS BIGINT) * 1000 + 3) // 7 AS rounded, CAST(least((CAST(l_quantity AS BIGINT) * 10000 + 6) // 12, 10000) AS INTEGER) AS scaled, CAST(least((CAST(trunc(l_extendedprice) AS BIGINT) * 10000 + 50000) // 100000, 10000) AS INTEGER) AS scaled_milli FROM lineitem",
        "amount_ratio": "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_partkey % 50 = 0 THEN 10000 ELSE least((CAST(trunc(l_extendedprice) AS BIGINT) * 1000 + (l_partkey % 50 * 100) // 2) // (l_partkey % 50 * 100), 10000) END AS INTEGER) AS ratio FROM lineitem",
        "vectorize_events": f"WITH {_VECTORS} SELECT event_id, {_V} FROM e",
        "json_payload_vectors": f"WITH {_VECTORS} SELECT event_id, {_V} FROM e",
        "partition_key_events": f"WITH {_VECTORS} SELECT event_id, part_key FROM e",
        "ref_quantize": _EMB,
        "ref_partition_hist": hist,
        "index_roundtrip": hist,
        "part_bbox": f"WITH {_VECTORS}, {parts} SELECT * FROM parts",
        "partition_widest_dim": f"WITH {_VECTORS}, {parts} SELECT part_key, {_WIDEST} AS dim FROM parts",
        "median_split": f"WITH {_VECTORS}, {parts}, w AS (SELECT part_key, n, {_WIDEST} AS dim FROM parts), x AS (SELECT ref_id, part_key, n, dim, [{_V}][dim + 1] AS x FROM r JOIN w USING (part_key)) SELECT ref_id, part_key, dim, CAST(CASE WHEN row_number() OVER (PARTITION BY part_key ORDER BY x, ref_id) <= n // 2 THEN 0 ELSE 1 END AS INTEGER) AS side FROM x",
        "index_counts": f'WITH {_VECTORS} SELECT count(*) AS "references", count(DISTINCT part_key) AS "partitions", CAST(sum(label) AS BIGINT) AS frauds FROM r',
        "json_extract_props": f"WITH {_FIELDS} SELECT event_id, true AS readable, installments, tx_count, merchant_id, mcc, is_online, strftime(last_ts, '%Y-%m-%dT%H:%M:%SZ') AS last_at FROM f",
        "json_payload_scores": f"WITH {_NEAR}, c AS ({_VOTE}) SELECT qid, qid % {b.BROKEN} <> 0 AS valid, CAST(CASE WHEN qid % {b.BROKEN} = 0 THEN 0 ELSE fraud_count END AS INTEGER) AS fraud_count, qid % {b.BROKEN} = 0 OR fraud_count < 3 AS approved, CASE WHEN qid % {b.BROKEN} = 0 THEN 0 ELSE fraud_count / 5.0::DOUBLE END AS fraud_score FROM c",
        "json_broken_bodies": f"SELECT event_id, event_id % {len(b.BREAKS) + 1} = 0 AS valid FROM events",
        "index_leaves": f"WITH {_VECTORS}, {parts} SELECT *, true AS leaves_fit, true AS leaves_enough FROM parts",
        "reference_files": f"SELECT {_V}, label, count(*) AS n FROM ({_EMB}) GROUP BY ALL",
        "risk_files": "SELECT CAST(s_suppkey * 37 % 1024 AS INTEGER) AS slot, CAST(arg_max(round(CAST(CAST(s_suppkey % 1000 / 1000.0::DOUBLE AS FLOAT) AS DOUBLE) * 10000), s_suppkey) AS INTEGER) AS mcc_risk_q FROM supplier GROUP BY 1",
        "l2_distance": f"WITH {_VECTORS} SELECT event_id, {' + '.join(f'CAST(v{i} - 5000 AS BIGINT) * (v{i} - 5000)' for i in range(DIMS))} AS d2 FROM e",
        "part_lower_bound": f"WITH {_VECTORS}, {parts} SELECT qid, parts.part_key AS target, {_LB} AS lb FROM q CROSS JOIN parts",
        "knn_top5": top,
        "knn_pruned_top5": top,
        "knn_vote": count,
        "knn_pruned_vote": count,
        "fraud_decision": f"""WITH {_NEAR}, c AS ({_VOTE}) SELECT qid, fraud_count, fraud_count < 3 AS approved, fraud_count / 5.0::DOUBLE AS fraud_score,
            '{{"approved":' || CASE WHEN fraud_count < 3 THEN 'true' ELSE 'false' END || ',"fraud_score":' || CAST(fraud_count / 5.0::DOUBLE AS VARCHAR) || '}}' AS response FROM c""",
        "knn_embeddings": f"WITH e AS ({_EMB}), q AS (SELECT vec_id AS qid, * EXCLUDE (vec_id) FROM e WHERE vec_id % {b.EVERY} = 0), r AS (SELECT vec_id AS ref_id, * EXCLUDE (vec_id) FROM e), d AS (SELECT qid, ref_id, r.label AS label, {_L2} AS d2 FROM q CROSS JOIN r) SELECT qid, CAST(rank AS INTEGER) AS rank, ref_id, label, d2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, ref_id) AS rank FROM d) WHERE rank <= 5",
    }
