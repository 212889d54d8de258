"""Decontamination: against a scan of its own, re-parameterised questions, slots, large benchmarks, edge cases."""

import difflib
import re
from collections import Counter, defaultdict

from ballotline.llm import decontam

DATA = "/root/testdata/sf0.01"
OUTER = "\"'`´’‘“”„«»()[]{}<>.,;:!?¡¿…*#&|~^_=\\/-—–"


def words(text):
    """[(value, template word)] by plain rules, word by word."""
    raw, out, first = [], [], True
    for line in (text or "").split("\n"):
        raw += [*line.split(), None]
    for x in raw:
        if x is None:
            first = True
            continue
        w = x.strip(OUTER)
        if any(c.isalnum() for c in w):
            low = w.lower()
            if low in decontam._NUMBER_WORDS or (not low.isalpha() and re.fullmatch(r"[+-]?[$€£]?\d[\d.,:/]*(st|nd|rd|th|%|e\d+)?", low)):
                kind = "<number>"
            elif low in decontam._UNITS or (low in decontam._LOOSE_UNITS and out and out[-1][1] == "<number>"):
                kind = "<unit>"
            elif w[0].isupper() and low != "i" and not (first and low in decontam._STARTERS):
                kind = "<name>"
            else:
                kind = low
            out.append((low, kind, w.isupper() and low != w))
        first = x.rstrip("\"'’”»)*#&%$|_~]")[-1:] in (".", "!", "?", ":")
    loud = {j for k in range(len(out) - 2) if all(out[k + i][2] for i in range(3)) for j in (k, k + 1, k + 2)}
    return [(low, low if k in loud and kind == "<name>" else kind) for k, (low, kind, _) in enumerate(out)]


def plain(docs, bench):
    """{doc: items}: windows as tuples of words compared with those of each item, the best stretch by trying all, slots by a longest alignment."""

    def wins(t):
        n = min(5, len(t))
        return [(k, tuple(t[k : k + n])) for k in range(len(t) - n + 1) if n and sum(x[0] != "<" for x in t[k : k + n]) >= min(2, n)]

    items = {}
    for i, t in bench:
        w = words(t)
        if found := {x for _, x in wins([k for _, k in w])}:
            items[i] = w, found
    out = {}
    for d, t in docs:
        mine = words(t)
        found, kinds = set(), [k for _, k in mine]
        w = wins(kinds)
        for i, (item, want) in items.items():
            at = [(k, x) for k, x in w if x in want]
            best = max(((len({x for k, x in at if a <= k <= a + len(item) * 3 // 2 + 5}), -a) for a, _ in at), default=(0, 0))
            if best[0] >= 0.8 * len(want):
                a = -best[1]
                part = mine[a : a + len(item) * 3 // 2 + 10]
                ways = defaultdict(Counter), defaultdict(Counter)
                for m in difflib.SequenceMatcher(None, [k for _, k in part], [k for _, k in item], autojunk=False).get_matching_blocks():
                    for j in range(m.size):
                        x, y = part[m.a + j], item[m.b + j]
                        if m.size >= 3 and y[1][0] == "<":
                            ways[0][x[0]][y[0]] += 1
                            ways[1][y[0]][x[0]] += 1
                total = sum(sum(c.values()) for c in ways[0].values())
                if not total or min(sum(max(c.values()) for c in way.values()) for way in ways) >= 0.8 * total:
                    found.add(i)
        out[d] = sorted(found)
    return out


def test_whole_table(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = decontam.report(docs, bench).collect()
    want = plain([(d.doc_id, d.text) for d in docs.collect()], [(b.item_id, b.text) for b in bench.collect()])
    assert len(rows) == docs.count() and {r.doc_id: r.items for r in rows} == want
    assert sum(r.contaminated for r in rows) >= 10
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {d for d, i in want.items() if not i}


ITEM = "A train leaves with Alice at 7 km from the old town and after 45 minutes it meets Bob who walked 7 km along the river to the bridge near the market."


def test_templates_and_slots(spark):
    texts = {
        1: f"before that. {ITEM} And more.",
        2: "Ask this: " + ITEM.replace("7", "12").replace("Alice", "Carol").replace("Bob", "Dave").replace("45", "50").replace("km", "miles"),
        3: "Ask this: " + ITEM.replace("7 km from", "12 miles from").replace("Alice", "Carol"),
        4: "A train leaves with Alice at 7 km from the old town. " + "Nothing else of it is here, only words. " * 5,
        11: ITEM.replace("Alice", "IBM").replace("Bob", "McDonald").replace("old", "new"), 12: ITEM.replace("Alice", "Bob").replace("45", "7"), 13: ITEM.upper(),
        5: None, 6: "", 7: "7 8 9 10 11 12 13 14", 8: (ITEM[:60] + " filler words come here and there ") * 3,
        9: "x y z " * 40_000 + ITEM, 10: ITEM.upper().lower(),
    }
    docs = spark.createDataFrame([(k, t, "z") for k, t in texts.items()] + [(None, ITEM, None), (1, texts[1], "z")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, "a b c d e f"), (4, "1 2 3 4 5 6"), (5, ITEM)], "item_id long, text string")
    rows = decontam.report(docs, bench).collect()
    assert len(rows) == len(texts) + 2
    caught = {r.doc_id: r.items for r in rows if r.contaminated}
    # of eight slots two disagree: in 3 one 7 and one km have other answers than the others, in 12 two names answer to one, and two numbers
    assert caught == {k: [1, 5] for k in (1, 2, 9, 11, None)}
    slots = {r.doc_id: r.consistency for r in decontam.find(docs, bench).collect()}
    by_slots = {k: f[2] for k in (3, 12) for f in decontam.Items([(1, ITEM)]).held_by(texts[k], decontam._Forms()) if f[1] >= 0.8}
    assert 3 not in slots and 12 not in slots and by_slots == {3: 0.75, 12: 0.75}
    three = [r for r in decontam.find(docs, bench).where("doc_id = 2").collect()]
    assert three[0].consistency == 1.0 and three[0].share > 0.8
    items = decontam.Items([(1, ITEM)])
    scrambled = "Ask this: " + ITEM.replace("7 km from", "12 km from").replace("walked 7", "walked 99")
    loose = items.held_by(scrambled, decontam._Forms())[0]
    assert loose[1] >= 0.8 and loose[2] < 1
    assert decontam.report(docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontam.report(docs, bench.limit(0)).collect())
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns


def test_large_benchmarks_lose_nothing(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    literal = spark.createDataFrame([(900, "What is 12 + 15 ?"), (901, "Who wrote Hamlet?"), (902, "Solve 12 + 5 * 3 - 4 = 19 kg"), (902, "of the and which of it is"), (903, "")], "item_id long, text string")
    bench = bench.union(literal).union(bench.limit(3).selectExpr("item_id + 1000", "text"))
    docs = docs.union(docs.limit(2)).union(docs.limit(3).selectExpr("CAST(NULL AS long)", "concat(text, ' Who wrote Hamlet? What is 12 + 15 ? So.')", "lang", "source", "n_chars"))
    whole = sorted(map(repr, decontam.report(docs, bench).collect()))
    found = sorted(map(repr, decontam.find(docs, bench).collect()))
    clean = sorted(map(repr, decontam.drop_contaminated(docs, bench).collect()))
    assert len(found) > 20 and len(clean) < len(whole)
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 300)
    assert decontam.small(decontam._items(bench, "item_id", "text")) is None
    assert sorted(map(repr, decontam.report(docs, bench).collect())) == whole
    assert sorted(map(repr, decontam.find(docs, bench).collect())) == found
    assert sorted(map(repr, decontam.drop_contaminated(docs, bench).collect())) == clean


def test_templates():
    forms = decontam._Forms()
    kinds = lambda t: ["x" if s else w for w, s in zip(*decontam.template(t, forms)[::2])]
    assert kinds("In April IBM asked McDonald for 5 in of cloth in June. Anna went in") == ["In", "x", "x", "asked", "x", "for", "x", "x", "of", "cloth", "in", "x", "x", "went", "in"]
    assert kinds("I gave A to the second box, 3 m long; ALL OF IT IS LOUD") == ["I", "gave", "x", "to", "the", "second", "box,", "x", "x", "long;", "ALL", "OF", "IT", "IS", "LOUD"]
    assert kinds("The 7 km and km or m") == ["The", "x", "x", "and", "x", "or", "m"]
    item = "Anna has 12 apples. Peter gives her 5 more apples and Maria takes 3 of them in May. How many apples does Anna have now?"
    again = item.replace("Anna", "IBM").replace("Peter", "McDonald").replace("Maria", "X").replace("12", "90").replace("May", "June")
    (_, share, slots, _), = decontam.Items([(1, item)]).held_by(f"Well then: {again}", forms)
    assert share == 1.0 and slots == 1.0


REPEATING = [
    "There were 12 apples in the first box, there were 15 apples in the second box and there were 19 apples in the third box. How many apples were there in all of the boxes?",
    "On the first day the shop sold 30 cakes. On the second day the shop sold 45 cakes. On the third day the shop sold 25 cakes. How many cakes did the shop sell?",
    "The farmer Anna has 12 cows and the farmer Peter has 17 cows and the farmer Maria has 23 cows. How many cows do the farmers have together?",
]


def test_items_that_repeat_a_phrase_are_found_as_copies():
    forms, items = decontam._Forms(), decontam.Items(list(enumerate(REPEATING)))
    for k, item in enumerate(REPEATING):
        for text in (item, f"Some words before. {item} And words after it.", f"{item} {item}", item.replace(" and ", " and also "), item.replace("12", "40").replace("30", "80")):
            found = {f[0]: f for f in items.held_by(text, forms)}[k]
            assert found[2] == 1.0 and (found[1] == 1.0 or "also" in text)
    loose = decontam.Items([(1, ITEM)]).held_by(ITEM.replace("walked 7", "walked 99") + " " + ITEM[:40], forms)[0]
    assert loose[1] == 1.0 and loose[2] < 1


def test_items_without_countable_windows_are_found(spark):
    bench = ["Solve 12 + 5 * 3 - 4 = 19 kg", "Barack Obama Met Angela Merkel In Berlin Germany", "What is 12 + 15 ?", "Who wrote Hamlet?", ITEM, "1 2 3 4 5 6", "Yes", "? !", "12 kg"]
    texts = {k: f"Some text before it. {b} And some more\nwords after it." for k, b in enumerate(bench)}
    texts |= {20: "A 1 2 3 4 5 7 B", 21: "What is 12 - 15 ?\nWhat is 13 + 15 in all", 22: "Barack Obama met Peter in Berlin", 23: "so WHO WROTE\nhamlet then", 24: "who wrote the play Hamlet", 25: "What is 77 + 99 ?", 26: None, 27: "", 28: "Yes"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    got = {r.doc_id: r.items for r in decontam.report(docs, items).collect()}
    assert {d: i for d, i in got.items() if i} == {k: [k] for k in range(9) if k not in (6, 7)} | {23: [3], 25: [2], 28: [6]}
    assert {r.doc_id for r in decontam.drop_contaminated(docs, items).collect()} == {d for d, i in got.items() if not i}
    at = {(r.doc_id, r.item_id): r.word for r in decontam.find(docs, items).collect()}
    assert at[0, 0] == at[2, 2] == at[4, 4] == 4 and at[23, 3] == 1
