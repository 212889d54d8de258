"""License scans: against a plain scan of every rule, suppression, edge cases."""

import re

from ballotline.llm import licenses
from ballotline.llm.license_rules import ANCHORS, BASE, KINDS, rules

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    base = [(k, label) for k in range(len(w)) for p, label in BASE if w[k : k + len(p.split())] == p.split()]
    norm = " " + " ".join(w) + " "
    finds = [(m.start(), m.end(), r["priority"], k, r) for k, r in enumerate(rules()) for m in re.finditer(f"(?<= )(?:{r['pattern']})(?= )", norm)]
    alive = []
    for f in finds:
        held = any(g is not f and g[0] <= f[0] and g[1] >= f[1] and g[2] >= f[2] and ((g[0], -g[1], -g[2], g[3]) < (f[0], -f[1], -f[2], f[3])) for g in finds)
        if f[4]["base"] or not held:
            alive.append(f)
    at = [k for k, _ in base]
    join = lambda s: ",".join(sorted(set(s)))
    return (len(w), len(base), min(at, default=None), max(at, default=None), join(x for _, x in base), join(f[4]["label"] for f in alive), max((KINDS[f[4]["kind"]] for f in alive), default=0.0), len(alive))


def row(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, r.n_finds)


def test_rules():
    table = rules()
    assert len(table) > 200
    for r in table:
        assert any(a in r["keyword"] for a in ANCHORS), r


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {d.doc_id: d.text for d in docs.collect()}
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert row(r) == plain(text[r.doc_id])
    assert any("gpl-3" in r.labels for r in rows) and any(r.n_base for r in rows)


def test_suppression_and_edges(spark):
    texts = [
        None, "", " ", "Under the MIT License", "under the-mit license; under the MIT\nLICENSE! x", "thunder the mit license",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC-SA 4.0 and cc by nc",
        "Apache License, Version 2.0 Apache License, Version 2.0", "É under the mit license ÉÀ", "UNDER THE KIT LICENSE under the mıt license",
        "Licensed under CC-BY 4.0. Copyright 2020 by someone, all rights reserved. SPDX-License-Identifier: (MIT)",
        "word " * 30_000 + "under the mit license " * 700 + "mozilla public license version 2.0",
    ]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(0, None, None)], "doc_id long, text string, labels string")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r.doc_id < len(texts) - 1:
            assert row(r) == plain(texts[r.doc_id]), texts[r.doc_id]
    by = {r.doc_id: r for r in rows}
    assert by[6].labels == "gpl-3" and by[7].labels == "cc-by-nc,cc-by-nc-sa" and by[8].labels == "apache-2"
    big = by[len(texts) - 1]
    assert (big.n_base, big.first_word, big.last_word, big.labels) == (700, 30_000, 30_000 + 4 * 699, "mit,mpl-2")
    assert licenses.scan(docs.limit(0)).collect() == []
