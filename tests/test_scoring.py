"""Files to decisions end to end: made-up files against plain Python."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from ballotline.constants import MCC_RISK, VECTOR
from ballotline.operators.payload import extract, raw_features, vectors
from ballotline.plans import scoring
from ballotline.sources import index as index_io
from ballotline.sources.references import default_mcc_risk, load_mcc_risk, load_normalization, load_references, quantize_references

DAY = 1440


def made_up(seed: int, n_refs: int, n_bodies: int) -> tuple[list, list]:
    r = random.Random(seed)
    vector = lambda: [-1 if i in (5, 6) and r.random() < 0.2 else float(r.randrange(2)) if i in (9, 10, 11) else round(r.random(), 4) for i in range(14)]
    refs = [{"vector": vector(), "label": r.choice(["fraud", "legit", "legit", "other"])} for _ in range(n_refs)]
    bodies = []
    for k in range(n_bodies):
        merchants = [f"M{r.randrange(30)}" for _ in range(r.randrange(6))]
        bodies.append({
            "id": f"t{k}", "transaction": {"amount": round(r.random() * 12000, 2), "installments": r.randrange(15), "requested_at": f"2026-03-{r.randrange(1, 29):02}T{r.randrange(24):02}:{r.randrange(60):02}:{r.randrange(60):02}Z"},
            "customer": {"avg_amount": round(r.random() * 900, 2) if k % 9 else 0, "tx_count_24h": r.randrange(25), "known_merchants": merchants}, "merchant": {"id": f"M{r.randrange(30)}", "mcc": r.choice([*MCC_RISK, "1315", "1", "0"]), "avg_amount": round(r.random() * 500, 2)},
            "terminal": {"is_online": r.random() < 0.5, "card_present": r.random() < 0.5, "km_from_home": r.random() * 1100}, "last_transaction": None if k % 4 == 0 else {"timestamp": f"2026-03-{r.randrange(1, 29):02}T{r.randrange(24):02}:{r.randrange(60):02}:59Z", "km_from_current": r.random() * 1200},
        })
    return refs, bodies


def plain_vector(p: dict) -> list[int]:
    import numpy as np

    milli = lambda x: 0 if x <= 0 else int(float(np.float32(x)) * 1000 + 0.5)
    div = lambda n, d: min((n * 10000 + d // 2) // d, 10000)
    minutes = lambda t: (int(t[8:10]) + 59 + (int(t[:4]) - 2026) * 365) * DAY + int(t[11:13]) * 60 + int(t[14:16])
    t, c, m, e, last = p["transaction"], p["customer"], p["merchant"], p["terminal"], p["last_transaction"]
    a, avg, now = milli(t["amount"]), milli(c["avg_amount"]), minutes(t["requested_at"])
    weekday = (int(t["requested_at"][8:10]) + 5) % 7  # March 2026 begins on a Sunday
    risk = {int(k) % 1024: round(v * 10000) for k, v in MCC_RISK.items()}
    return [
        div(a, 10_000_000), div(t["installments"], 12), 10000 if not avg else min((a * 1000 + avg // 2) // avg, 10000), div(int(t["requested_at"][11:13]), 23), div(weekday, 6), -10000 if not last else div(max(now - minutes(last["timestamp"]), 0), DAY), -10000 if not last else div(milli(last["km_from_current"]), 1_000_000),
        div(milli(e["km_from_home"]), 1_000_000), div(c["tx_count_24h"], 20), 10000 * e["is_online"], 10000 * e["card_present"], 10000 * (m["id"] not in c["known_merchants"]), risk.get(int(m["mcc"]) % 1024, 0), div(milli(m["avg_amount"]), 10_000_000),
    ]


def quantized(x: float) -> int:
    return -10000 if x <= -1 else 0 if x <= 0 else 10000 if x >= 1 else int(x * 10000 + 0.5)


@pytest.mark.parametrize("packed", [False, True])
def test_files_to_decisions(spark, tmp_path, packed):
    refs, bodies = made_up(1 + packed, 6000, 40)
    raw = json.dumps(refs).encode()
    source = tmp_path / ("refs.json.gz" if packed else "refs.json")
    source.write_bytes(gzip.compress(raw) if packed else raw)
    (tmp_path / "risk.json").write_text(json.dumps(MCC_RISK | {"no number": 0.9}, indent=1))
    out = str(tmp_path / "index")
    scoring.build(spark, str(source), str(tmp_path / "risk.json"), out, 32)
    held, risk = index_io.read_index(spark, out)
    assert held.refs.count() == 6000 and {r.leaf_id for r in held.refs.select("leaf_id").distinct().collect()} != {1}
    rows = [(b["id"], json.dumps(b)) for b in bodies] + [("bad", "[]"), ("none", None)]
    df = spark.createDataFrame(rows, "qid string, body string")
    got = {r.qid: r for r in scoring.score(df, held, risk).collect()}
    seen = {r.qid: [r[v] for v in VECTOR] for r in vectors(raw_features(extract(df), risk).where("valid"), ("qid",)).collect()}
    points = [([quantized(x) for x in r["vector"]], r["label"] == "fraud") for r in refs]
    for b in bodies:
        v = plain_vector(b)
        assert seen[b["id"]] == v
        near = sorted((sum((x - y) ** 2 for x, y in zip(v, p)), k, f) for k, (p, f) in enumerate(points))[:5]
        n = sum(f for _, _, f in near)
        r = got[b["id"]]
        if len({d for d, _, _ in near}) == 5:  # ids of the file's rows aren't known here
            assert (r.valid, r.fraud_count, r.approved, r.fraud_score) == (True, n, n < 3, n / 5)
            assert json.loads(r.response) == {"approved": n < 3, "fraud_score": n / 5}
    assert all((not got[i].valid, got[i].approved, got[i].fraud_score) == (True, True, 0.0) for i in ("bad", "none"))
    brute_rows = scoring.score(df, held, risk, strategy="brute").select("qid", "fraud_count").collect()
    assert {r.qid: r.fraud_count for r in brute_rows} == {q: r.fraud_count for q, r in got.items()}


def test_lookups(spark, tmp_path):
    (tmp_path / "risk.json").write_text(json.dumps(MCC_RISK, indent=2))
    assert sorted(map(tuple, load_mcc_risk(spark, str(tmp_path / "risk.json")).collect())) == sorted(map(tuple, default_mcc_risk(spark).collect()))
    (tmp_path / "norm.json").write_text(json.dumps({"max_amount": 10000, "max_installments": 12, "amount_vs_avg_ratio": 10, "max_minutes": 1440, "max_km": 1000, "max_tx_count_24h": 20, "max_merchant_avg_amount": 10000}, indent=1))
    n = load_normalization(spark, str(tmp_path / "norm.json")).first()
    assert (n.max_amount, n.max_installments, n.amount_vs_avg_ratio, n.max_minutes, n.max_km, n.max_tx_count_24h, n.max_merchant_avg_amount) == (10000, 12, 10, 1440, 1000, 20, 10000)


def test_damaged_index(spark, tmp_path):
    (tmp_path / "refs.json").write_text(json.dumps(made_up(3, 80, 0)[0]))
    refs = quantize_references(load_references(spark, str(tmp_path / "refs.json")).withColumn("ref_id", F.monotonically_increasing_id()))
    out = str(tmp_path / "index")
    index_io.write_index(index_io.build_index(refs), default_mcc_risk(spark), out)
    index_io.read_index(spark, out)
    refs.limit(3).withColumn("leaf_id", F.lit(1).cast("long")).withColumn("part_key", F.lit(1)).write.mode("append").partitionBy("part_key").parquet(f"{out}/references")
    with pytest.raises(ValueError, match="references"):
        index_io.read_index(spark, out)


def test_command_line(spark, tmp_path):
    from ballotline.__main__ import main

    refs, bodies = made_up(5, 300, 8)
    (tmp_path / "refs.json").write_text(json.dumps(refs))
    (tmp_path / "risk.json").write_text(json.dumps(MCC_RISK))
    (tmp_path / "bodies.txt").write_text("\n".join(json.dumps(b) for b in bodies))
    index, out = str(tmp_path / "index"), str(tmp_path / "out")
    assert main(["build", str(tmp_path / "refs.json"), str(tmp_path / "risk.json"), index]) == 0
    assert main(["score", index, str(tmp_path / "bodies.txt"), out]) == 0
    assert spark.read.parquet(out).where("valid").count() == 8 and main([]) == main(["score", "a", "b", "c", "d"]) == 2
