"""Bodies: what is missing, null, of another type or malformed; and the stream."""

import json
from pathlib import Path

import pytest

from ballotline.constants import VECTOR
from ballotline.functions.vectors import partition_key
from ballotline.operators.tables import shared_folder
from ballotline.operators.payload import extract, raw_features, vectors
from ballotline.sources.index import build_index
from ballotline.sources.references import default_mcc_risk
from ballotline.streaming.scoring import score_stream

GOOD = {
    "id": "t", "transaction": {"amount": 73.5, "installments": 4, "requested_at": "2026-05-20T09:15:40Z"}, "customer": {"avg_amount": 98.0, "tx_count_24h": 7, "known_merchants": ["shop-a", "shop-b"]},
    "merchant": {"id": "shop-b", "mcc": "5411", "avg_amount": 44.4}, "terminal": {"is_online": False, "card_present": True, "km_from_home": 31.25}, "last_transaction": None,
}
OUT = object()


def body(path=None, value=OUT, good=GOOD):
    d = json.loads(json.dumps(good))
    if path:
        at, *_, key = [d, *path.split(".")] if "." not in path else [d[path.split(".")[0]], path.split(".")[1]]
        if value is OUT:
            del at[key]
        else:
            at[key] = value
    return json.dumps(d)


LAST = GOOD | {"last_transaction": {"timestamp": "2026-05-20T08:30:00Z", "km_from_current": 5.0}}
CASES = [
    (body(), True), (body("transaction.installments"), True), (body("customer"), True), (body("terminal.is_online"), True), (body("merchant.mcc"), True), (body("last_transaction"), True), (body("last_transaction", {}), True),
    (body("transaction.requested_at"), False), (body("transaction"), False), (body("transaction.installments", None), False), (body("customer", None), False), (body("terminal.is_online", None), False), (body("merchant.id", None), False),
    (body("transaction.amount", "12"), False), (body("transaction.installments", 2.0), False), (body("transaction.installments", -2), False), (body("transaction.installments", 4294967295), True), (body("transaction.installments", 4294967296), False),
    (body("merchant.mcc", 5411), False), (body("merchant.mcc", "12a"), False), (body("merchant.mcc", ""), True), (body("merchant.mcc", "1315"), True), (body("terminal.is_online", 1), False), (body("terminal.is_online", "true"), False),
    (body("transaction.amount", float("nan")), False), (body("transaction.amount", "NaN"), False), (body().replace("73.5", "1e400"), True), ("[" + body() + "]", False), (body() + " trailing", True), (body()[:-1], False), (body().replace("}}", "},}"), None),
    ("", False), (None, False), ("{}", False), ("  " + body(), True), (body("customer.known_merchants", None), False), (body("customer.known_merchants", []), True), (body("last_transaction", {"timestamp": None}), False),
    (body("last_transaction", {"km_from_current": None}), False), (body("last_transaction", {"timestamp": "no time"}), True), (body("transaction.requested_at", "2026-02-31T00:00:00Z"), True), (body().replace('"amount"', '"amount": 7, "amount"', 1), True), (body("other", 1, GOOD | {"other": 0}), True),
]


def parsed(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "qid long, body string")
    return raw_features(extract(df), default_mcc_risk(spark))


def test_outcomes(spark):
    got = {r.qid: r.valid for r in parsed(spark, [t for t, _ in CASES]).collect()}
    for k, (text, want) in enumerate(CASES):
        assert want is None or got[k] == want, (text, want)


def vector(spark, *texts):
    raw = parsed(spark, texts)
    return [[r[v] for v in VECTOR] for r in vectors(raw.where("valid"), ("qid",)).orderBy("qid").collect()]


def test_vectors(spark):
    good, zero, alias, none, rolled, moved, since = vector(
        spark, body(), body("customer.avg_amount", 0), body("merchant.mcc", "1315"), body("merchant.mcc", "0"), body("transaction.requested_at", "2026-02-31T10:00:00Z"), body("transaction.requested_at", "2026-03-03T10:00:00Z"), json.dumps(LAST)
    )
    assert good == [74, 3333, 750, 3913, 3333, -10000, -10000, 313, 3500, 0, 10000, 0, 1500, 44]
    assert zero[2] == 10000 and alias[12] == 1500 and none[12] == 0 and rolled == moved and since[5:7] == [313, 50]
    part = vector(spark, body("last_transaction", {"km_from_current": 5.0}), body("last_transaction", {"timestamp": "2026-05-20T09:15:59Z"}))
    assert [v[5:7] for v in part] == [[-10000, 50], [0, -10000]]
    known = vector(spark, body("merchant.id", "shop-z"), body("customer.known_merchants"), body("merchant.id"))
    assert [v[11] for v in known] == [10000] * 3


@pytest.mark.parametrize("again", [False, True])
def test_stream(spark, tmp_path, again):
    refs = spark.createDataFrame([(k, *[k * 100 % 10000] * 14, k % 2) for k in range(200)], f"ref_id long, {', '.join(f'{v} int' for v in VECTOR)}, label int").withColumn("part_key", partition_key())
    held, risk = build_index(refs), default_mcc_risk(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    shared = Path(shared_folder(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    for part in range(2 + again):
        spark.createDataFrame([(part * 10 + k, body() if k else "[]") for k in range(5)], "qid long, body string").coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema("qid long, body string").json(source)
        score_stream(stream, held, risk, out, str(tmp_path / "check"), available_now=True).awaitTermination()
    assert set(shared.iterdir()) == before  # batches leave no tables behind
    rows = spark.read.parquet(out).collect()
    assert sorted(r.qid for r in rows) == [p * 10 + k for p in range(2 + again) for k in range(5)]
    assert sum(not r.valid for r in rows) == 2 + again and all(r.approved for r in rows if not r.valid)
