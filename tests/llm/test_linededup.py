"""Line dedup: against one pass over sorted documents, shift resistance, edge cases."""

import random

from ballotline.llm import linededup

DATA = "/root/testdata/sf0.01"


def plain(rows):
    """{(id, text): new text} by one pass in order."""
    from ballotline.llm.common import F  # noqa: F401

    seen, out = set(), {}
    for doc, key, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        kept = []
        for chunk, may, _ in linededup.chunks(text):
            if not may or chunk not in seen:
                kept.append(chunk)
            if may:
                seen.add(chunk)
        out[doc, text] = None if text is None else "\n".join(kept)
    return out


def plain_runs(rows):
    """The same with repeated runs: whatever unit of lines stood before, in another place, goes."""
    first, out = {}, {}
    for doc, key, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        gone, parts = set(), linededup.chunks(text)
        starts = [sum(m for _, _, m in parts[:k]) for k in range(len(parts))]
        spans = [(starts[k], starts[k] + m - 1, "c" + chunk) for k, (chunk, may, m) in enumerate(parts) if may]
        spans += [(lo, hi, b"w" + raw) for lo, hi, raw in linededup.windows(text)]
        for k, (lo, hi, what) in enumerate(spans):
            if first.setdefault(what, (doc, key, k)) != (doc, key, k):
                gone.update(range(lo, hi + 1))
        out[doc, text] = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def repeated_runs(rows):
    """{(id, text): its lines in runs of two lines or more, of twelve words or more together, of which every two neighbours stood together in an earlier text}."""
    pairs, out = set(), {}
    for doc, _, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        lines = [(k, x) for k, x in enumerate((text or "").split("\n")) if x.split()]
        run, found = [], set()
        for j, (k, x) in enumerate(lines):
            if j and (lines[j - 1][1], x) in pairs:
                run = [*(run or [lines[j - 1]]), (k, x)]
            else:
                run = []
            if sum(len(y.split()) for _, y in run) >= linededup.LEAST:
                found.update(i for i, _ in run)
        out[doc, text] = found
        pairs.update((a[1], b[1]) for a, b in zip(lines, lines[1:]))
    return out


def test_runs_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = keyed(docs)
    want = {d: t for (d, _), t in plain_runs(rows).items()}
    out = linededup.line_dedup(docs.repartition(6), runs=True).collect()
    assert {r.doc_id: r.text for r in out} == want
    # the share of lines in repeated runs that goes
    caught = total = 0
    kept = {r.doc_id: r.n_removed_lines for r in out}
    for (doc, text), lines in repeated_runs(rows).items():
        total += len(lines)
        caught += min(len(lines), kept[doc])
    assert total > 500 and caught >= 0.95 * total, (caught, total)


def keyed(docs):
    from pyspark.sql import functions as F

    return [(r.doc_id, r.k, r.text) for r in docs.select("doc_id", F.xxhash64("text").alias("k"), "text").collect()]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {d: t for (d, _), t in plain(keyed(docs)).items()}
    rows = linededup.line_dedup(docs.repartition(6)).collect()
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == docs.count()
    before = {d.doc_id: d.text for d in docs.collect()}
    assert all(r.n_lines - r.n_removed_lines == r.text.count("\n") + 1 for r in rows if r.text)
    assert any(r.n_removed_chunks for r in rows) and all(r.text == before[r.doc_id] for r in rows if not r.n_removed_chunks)


def test_chunks_join_to_the_text_and_resist_shifts():
    rnd = random.Random(2)
    line = lambda: " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 5) for _ in range(rnd.randrange(0, 20)))
    for _ in range(200):
        lines = [line() for _ in range(40)]
        assert "\n".join(c for c, _, _ in linededup.chunks("\n".join(lines))) == "\n".join(lines)
        a = {c for c, _, _ in linededup.chunks("\n".join(lines))}
        b = {c for c, _, _ in linededup.chunks("\n".join([*lines[:5], "new line", *lines[5:]]))}
        assert len(b - a) <= 9
    assert linededup.chunks(None) == [] and linededup.chunks("") == [("", False, 1)]


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(60))
    block = "\n".join(f"line {k} of the block that repeats in places" for k in range(40))
    rows = [
        (3, f"start\n{long}\nend", "x"), (1, f"other\n{long}", None), (1, f"other\n{long}", None), (None, long, "x"), (7, None, "x"), (8, "", "x"),
        (9, long, "x"), (10, "Licensed under X.", "x"), (11, "Licensed under X.", "x"), (12, f"{block}\ntail", "x"), (13, f"head\nhead 2\n{block}", "x"),
        (14, "a b c\n" * 50_000, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(5)
    want = plain(keyed(docs))
    got = linededup.apply(docs)
    assert got.columns == docs.columns
    out = got.collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[3] == ["start\nend"] and by[1] == [f"other\n{long}"] * 2 and by[None] == by[9] == [""]
    assert by[7] == [None] and by[8] == [""] and by[10] == by[11] == ["Licensed under X."]
    assert all(t == want[d, s] for d, s, _ in rows for t in by[d])
    assert by[12] == [f"{block}\ntail"] and len(by[13][0]) < 0.6 * len(block)
    assert linededup.line_dedup(docs.limit(0)).collect() == [] and linededup.apply(docs.limit(0)).collect() == []


def test_repeated_runs_of_short_lines_go_whole(spark):
    rnd = random.Random(5)
    line = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(n))
    rows, rest = [], {}
    for k, sizes in enumerate(([14] * 4, [12] * 5, [10] * 6, [5] * 20, [11, 1, 1, 1, 20, 1, 1], [3, 30, 3, 30, 3], [15, 1, 1, 1]) * 8):
        run = [line(n) for n in sizes]
        if k % 2:
            run.insert(2, "")
        own = [line(3 + j) for j in range(4)]
        rows += [(2 * k, "\n".join([line(4), *run, line(9)])), (2 * k + 1, "\n".join([*own[:2], *run, *own[2:]]))]
        rest[2 * k + 1] = "\n".join(own)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in linededup.line_dedup(docs, runs=True).collect()}
    assert all(got[k].text == t for k, t in rest.items()) and all(got[k].text == t for k, t in rows if k not in rest)
    assert {r.doc_id: r.text for r in linededup.apply(docs, runs=True).collect()} == {k: r.text for k, r in got.items()}
    # a run within one text keeps its first twelve words
    docs = spark.createDataFrame([(1, "a b c\n" * 9 + "end"), (2, "x\n" + "a b c\n" * 5 + "y"), (3, "Licensed under X.\n\nend"), (4, "Licensed under X.\n\nend")], "doc_id long, text string")
    assert [r.text for r in linededup.line_dedup(docs, runs=True).orderBy("doc_id").collect()] == ["a b c\n" * 4 + "end", "x\ny", *["Licensed under X.\n\nend"] * 2]


def test_chunks_given_out_early_change_nothing(spark):
    import pyarrow as pa

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [*keyed(docs), *keyed(docs)[:40]]
    batches = [pa.RecordBatch.from_pylist([{"id": d, "key": k, "text": t} for d, k, t in rows[j : j + 100]], pa.schema([("id", pa.int64()), ("key", pa.int64()), ("text", pa.string())])) for j in range(0, len(rows), 100)]

    def gone(most):
        own = [r for b in linededup._locals(iter(batches), True, most) for r in b.to_pylist()]
        met = sorted(own, key=lambda r: (r["hash"] is not None, r["hash"] or 0, r["id"], r["key"], r["at"]))
        b = pa.RecordBatch.from_pylist(met, pa.schema([("id", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("hash", pa.int64()), ("chunk", pa.binary())]))
        return len(own), {tuple(r.values()) for out in linededup._repeats(iter([b])) for r in out.to_pylist()}

    (n, whole), (m, early) = gone(linededup.HELD), gone(20_000)
    assert whole == early and len(whole) > 500 and m > n
