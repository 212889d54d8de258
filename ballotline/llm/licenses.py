"""License scans: ordered signature rules over normalised words.

Each text is normalised once. A few anchor words gate whole texts, each rule's
keyword gates the rule, and only then its regex runs. Finds are intervals of the
normalised text. One sweep in order of (start, longest first, priority) drops a
find that lies inside one of the same or a higher priority; it keeps only the
furthest end of each priority, so its work is linear in the finds. Everything
happens inside the row with SQL functions: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, spans_sql
from .license_rules import ANCHORS, KINDS, rules

_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rule_table() -> str:
    rows = [f"named_struct('kw', {quoted(r['keyword'])}, 're', {quoted('(?<= )(?:' + r['pattern'] + ')(?= )')}, 'p', {r['priority']}, 'r', {k})" for k, r in enumerate(rules())]
    return f"array({', '.join(rows)})"


def _finds() -> str:
    """SQL: ARRAY of (s, ne, np, r) of every rule's matches in ``__norm``: start, minus end, minus priority, rule."""
    one = f"transform({spans_sql('__norm', 'q.re')}, x -> named_struct('s', x.s, 'ne', -x.e, 'np', -q.p, 'r', q.r))"
    return f"sort_array(flatten(transform(filter({_rule_table()}, q -> contains(__norm, q.kw)), q -> {one})))"


def _sweep() -> str:
    table = rules()
    labels = "array(" + ", ".join(quoted(r["label"]) for r in table) + ")"
    n_base = sum(r["base"] for r in table)
    sure = "array(" + ", ".join(f"{v}D" for v in KINDS.values()) + ")"
    base = f"d.r < {n_base}"
    label = f"element_at({labels}, d.r + 1)"
    stays = f"({base} OR element_at(a.ends, 1 - d.np) < -d.ne)"
    return f"""aggregate(__finds,
        named_struct('ends', array_repeat(-1, {len(KINDS)}), 'labels', cast(array() AS array<string>), 'base', cast(array() AS array<string>),
            'n', 0L, 'lo', cast(NULL AS int), 'hi', cast(NULL AS int), 'score', 0D, 'finds', 0L),
        (a, d) -> named_struct(
            'ends', transform(a.ends, (x, i) -> CASE WHEN i <= -d.np THEN greatest(x, -d.ne) ELSE x END),
            'labels', CASE WHEN {stays} THEN array_union(a.labels, array({label})) ELSE a.labels END,
            'base', CASE WHEN {base} THEN array_union(a.base, array({label})) ELSE a.base END,
            'n', a.n + CASE WHEN {base} THEN 1L ELSE 0L END,
            'lo', CASE WHEN {base} THEN least(a.lo, d.s) ELSE a.lo END,
            'hi', CASE WHEN {base} THEN greatest(a.hi, d.s) ELSE a.hi END,
            'score', CASE WHEN {stays} THEN greatest(a.score, element_at({sure}, 1 - d.np)) ELSE a.score END,
            'finds', a.finds + CASE WHEN {stays} THEN 1L ELSE 0L END))"""


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document: the columns ``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score, n_finds.

    Base places count whatever else is found and keep their labels; labels are sorted and
    comma-joined ('' if none); score is the confidence of the best find (0 if none); n_finds
    counts the finds that no other suppresses. Null and empty texts have no words and no
    finds. Repeated rows give repeated results; further columns are ignored, whatever their names.
    """
    names = [f"k{i}" for i in range(len(keep))]
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _BREAK, " ")), F.lit(" ")).alias("__raw"))
    held = held.withColumn("__n", F.when(F.col("__raw") == "  ", F.lit(0)).otherwise(_spaces(F.col("__raw")) - 1).cast("long"))
    held = held.withColumn("__low", F.lower("__raw"))
    gate = F.lit(False)
    for a in ANCHORS:
        gate = gate | F.contains(F.col("__low"), F.lit(a))
    held = held.select(*names, "__n", F.when(gate, F.translate("__raw", _UPPER, _UPPER.lower())).alias("__norm"))
    held = held.withColumn("__finds", F.expr(f"CASE WHEN __norm IS NOT NULL THEN {_finds()} ELSE array() END"))
    held = held.withColumn("__r", F.expr(_sweep()))
    before = lambda at: F.when(F.col(at).isNotNull(), _spaces(F.substring(F.col("__norm"), F.lit(1), F.col(at))) - 1)
    return held.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)],
        F.col("__n").alias("n_words"), F.col("__r.n").alias("n_base"), before("__r.lo").alias("first_word"), before("__r.hi").alias("last_word"),
        F.array_join(F.sort_array("__r.base"), ",").alias("base_labels"), F.array_join(F.sort_array("__r.labels"), ",").alias("labels"),
        F.col("__r.score").alias("score"), F.col("__r.finds").alias("n_finds"),
    )
