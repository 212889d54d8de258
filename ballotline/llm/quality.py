"""Quality rules: text statistics, fixed rules, and robust multivariate outliers.

Statistics. Words are split once. Repeated 3-word windows are found inside the row:
their hashes are compared with their distinct hashes, and only texts with a
repeat sort (hash, position) to find which windows, compared word by word, repeat.

Outliers. Each document that passes the fixed rules gives a vector of four statistics that
vary in any text: mean word length, shares of long words and of words with other signs than
letters and digits (both as arcsines of roots), and the share of distinct words (as logarithm). Words count
with 20 characters at most, so that one key or link moves nothing. A short text's statistics scatter more;
their distances from a fixed centre are therefore multiplied by sqrt(n / (n + PULL)), n its words.

For each (lang, source), and as a fallback for small groups each lang and the whole table, the minimum-covariance-
determinant estimate is found by concentration steps from four deterministic
starts: medians with absolute deviations, the same with correlations of tanh scores and of
spatial signs, and mean and covariance. A start goes on until its determinant no longer falls; the
smallest determinant wins. The covariance is scaled for the share of rows that it really covers. A document
goes if its squared Mahalanobis distance is over the chi-square quantile of LEVEL.

The steps run over grid cells with counts, not over documents: one aggregation
with partial sums makes them, so a hot source costs no more than others and every
step reads a table that stops growing once the cells are filled. A step sorts no rows: a histogram of distances
finds the nearest COVER, sums follow. All sums are integers, so results don't depend on partitions. DataFrame operations only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, bounded

_IN = r"[^\x20\x09-\x0D]"

DIMS = ("word_len", "long_words", "marked_words", "distinct_words")
_P = len(DIMS)
#: Cells of the grid in a unit of each statistic: about a quarter of its usual standard deviation.
GRID = (128, 64, 64, 32)
CENTRE = (2.35, 1.0, 0.7, 0.0)
PULL = 200
#: A word counts with so many characters at most; from LONG on it is a long one.
WIDEST, LONG = 20, 8
#: Share of the rows that an estimate covers.
COVER = 0.75
#: Most concentration steps; they end earlier once no determinant falls.
STEPS = 40
#: Fewest rows for a group's own estimate.
LEAST = 50
#: Share of normal rows beyond the cut.
LEVEL = 1e-6
#: Smallest standard deviation, in cells: a statistic that is alike in a group's nearest rows is known no better than the grid.
GUARD = 1.0
#: Most groups whose estimates are broadcast (about 200 bytes each); more are joined by a shuffle.
GROUPS = 20_000
_RINGS = 32


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words, n_cut, n_long, n_marked and n_distinct as LONG. Null text: no words."""
    body = F.coalesce(F.col(text), F.lit(""))
    held = docs.withColumn("__w", F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    held = held.withColumn("__lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    held = held.withColumn("__n", F.size("__w").cast("long"))
    held = held.withColumn("__h", F.expr("CASE WHEN __n < 3 THEN array() ELSE transform(sequence(1L, __n - 2), i -> xxhash64(element_at(__w, int(i)), element_at(__w, int(i + 1)), element_at(__w, int(i + 2)))) END"))
    again = F.expr("size(array_distinct(__h)) < size(__h)")
    held = held.withColumn("__s", F.when(again, F.expr("sort_array(transform(__h, (h, i) -> named_struct('h', h, 'i', i)))")))
    same = lambda k: f"coalesce(x.h = get(__s, {k}).h AND get(__w, x.i) = get(__w, get(__s, {k}).i) AND get(__w, x.i + 1) = get(__w, get(__s, {k}).i + 1) AND get(__w, x.i + 2) = get(__w, get(__s, {k}).i + 2), false)"
    twice = F.expr(f"filter(__s, (x, k) -> {same('k - 1')} OR {same('k + 1')})")
    held = held.withColumn("__p", F.when(again, F.sort_array(F.transform(twice, lambda x: x["i"].cast("long")))))
    cover = F.expr("aggregate(__p, named_struct('last', -3L, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last)), a -> a.n)")
    return held.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.col("__n").alias("n_words"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(cover, F.lit(0).cast("long")).alias("n_repeat_words"),
        (F.length(body) - F.length(F.regexp_replace(body, rf"(?<!{_IN})({_IN}{{{WIDEST}}}){_IN}++", "$1"))).cast("long").alias("n_cut"),
        F.regexp_count(body, F.lit(rf"(?<!{_IN}){_IN}{{{LONG},}}+")).cast("long").alias("n_long"),
        F.regexp_count(body, F.lit(rf"(?<!{_IN})[\p{{L}}\p{{M}}\p{{N}}]*+{_IN}++")).cast("long").alias("n_marked"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
    )


def base_failed(n_words: str = "n_words", repeats: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 50) | (100 * F.col(repeats) > 50 * F.col(n_words))


def vector() -> list[Column]:
    """The four statistics as whole numbers of grid cells from the centre."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda k: 2 * F.asin(F.sqrt((F.col(k) + 0.375) / (n + 0.75)))
    x = [F.log2(F.greatest(F.col("word_chars") - F.col("n_cut"), F.lit(1)) / n), share("n_long"), share("n_marked"), F.log2(F.greatest(F.col("n_distinct"), F.lit(1)) / n)]
    return [F.round((v - c) * F.sqrt(n / (n + PULL)) * g).cast("long").alias(f"q{k}") for k, (v, c, g) in enumerate(zip(x, CENTRE, GRID))]


def _chi4(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def chi_quantile(share: float) -> float:
    """Chi-square quantile with four degrees of freedom."""
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi4(mid) < share else (lo, mid)
    return lo


def chi_scale(cover: float) -> float:
    """What scales the covariance of the nearest ``cover`` of normal rows to theirs all, in 4 dimensions."""
    if cover >= 1:
        return 1.0
    x = chi_quantile(cover)
    return cover / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


CUT = chi_quantile(1 - LEVEL)
_SCALES = 512


_PAIRS = [(j, i) for j in range(_P) for i in range(j, _P)]
_PARAMS = [*(f"m{k}" for k in range(_P)), *(f"l{i}{j}" for i in range(_P) for j in range(i + 1))]


def _solve(df: DataFrame) -> DataFrame:
    """From m0.. and s00.. (moments): the guard, the Cholesky factor l00.., and its log determinant."""
    out = [f"greatest(s{k}{k}, {GUARD**2}D) AS v{k}" for k in range(_P)]
    for j, i in _PAIRS:
        rest = " - ".join([f"v{j}" if i == j else f"s{j}{i}", *(f"l{i}{k} * l{j}{k}" for k in range(j))])
        # a pivot keeps at least a hundredth of its variance, else rows on a line would give a zero
        out.append(f"sqrt(greatest({rest}, 0.01D * v{j})) AS l{j}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return df.selectExpr("*", *out, " + ".join(f"ln(l{k}{k})" for k in range(_P)) + " AS logdet")


def _distance_sql() -> str:
    z: list[str] = []
    for i in range(_P):
        z.append("((" + " - ".join([f"(q{i} - m{i})", *(f"l{i}{k} * {z[k]}" for k in range(i))]) + f") / l{i}{i})")
    return " + ".join(f"{x} * {x}" for x in z)


_DISTANCE = _distance_sql()


def distance() -> Column:
    """Squared distance of q0.. to m0.. under the factor l00.. ."""
    return F.expr(_DISTANCE)


def _sums(values: list[str]) -> list[Column]:
    """Sums of the weights n, of each value (a0..) and of each product (b00..)."""
    return [F.sum("n").alias("n"), *(F.expr(f"sum(n * {v})").alias(f"a{k}") for k, v in enumerate(values)), *(F.expr(f"sum(n * {values[j]} * {values[i]})").alias(f"b{j}{i}") for j, i in _PAIRS)]


def _centre(m: DataFrame, scale: str = "1D") -> DataFrame:
    """Means m0.. and covariances s00.. of sums, these times a scale in SQL."""
    return m.selectExpr("*", *[f"a{k} / n AS m{k}" for k in range(_P)], *[f"(b{j}{i} / n - (a{j} / n) * (a{i} / n)) * {scale} AS s{j}{i}" for j, i in _PAIRS])


def _medians(cells: DataFrame, near: Callable) -> DataFrame:
    """(grp, m0.., d0..): weighted medians and median absolute deviations of each statistic."""

    def median(rows: DataFrame) -> DataFrame:
        by = rows.groupBy("grp", "dim", "v").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("grp", "dim")
        by = by.withColumn("upto", F.sum("n").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w))
        return by.where(2 * F.col("upto") >= F.col("all")).groupBy("grp", "dim").agg(F.min("v").alias("mid"))

    long = cells.select("grp", "n", F.posexplode(F.array(*[f"q{k}" for k in range(_P)])).alias("dim", "v"))
    mid = median(long)
    off = median(long.join(near(mid), ["grp", "dim"]).select("grp", "dim", "n", F.abs(F.col("v") - F.col("mid")).alias("v"))).withColumnRenamed("mid", "off")
    pick = lambda c, k: F.max(F.when(F.col("dim") == k, F.col(c))).cast("double")
    return mid.join(off, ["grp", "dim"]).groupBy("grp").agg(*[pick("mid", k).alias(f"m{k}") for k in range(_P)], *[pick("off", k).alias(f"d{k}") for k in range(_P)])


_START = ["grp", "start", *_PARAMS, "logdet"]
_Q = [f"q{k}" for k in range(_P)]
_TABLE = "array(" + ", ".join(f"{chi_scale(COVER + (1 - COVER) * k / _SCALES)!r}D" for k in range(_SCALES + 1)) + ")"
_SCALE = f"element_at({_TABLE}, greatest(int(round((cover - {COVER}D) / {1 - COVER}D * {_SCALES})), 0) + 1)"
_RING = f"int(floor({_RINGS} * log2({_DISTANCE} + {2.0**-10}D)))"


def _starts(cells: DataFrame, near: Callable) -> DataFrame:
    """The four starts of each group, without a determinant yet."""
    mid = _medians(cells, near).selectExpr("grp", *[f"m{k}" for k in range(_P)], *[f"greatest(1.4826D * d{k}, {GUARD}D) AS d{k}" for k in range(_P)])
    mid = Table(mid, "medians").df
    score = [f"(q{k} - m{k}) / d{k}" for k in range(_P)]
    rows = cells.join(near(mid), "grp").selectExpr("grp", "n", *_Q, *[f"{x} AS z{k}" for k, x in enumerate(score)], f"greatest(sqrt({' + '.join(f'pow({x}, 2)' for x in score)}), 1e-9D) AS norm")
    # scores as whole numbers, so that their sums are exact
    rows = rows.selectExpr("grp", "n", *_Q, *[f"bigint(round(1024 * tanh(z{k}))) AS t{k}" for k in range(_P)], *[f"bigint(round(1024 * z{k} / norm)) AS u{k}" for k in range(_P)])
    kinds = F.explode(F.expr("array(" + ", ".join(f"named_struct('start', {s}, {', '.join(f'{chr(39)}x{k}{chr(39)}, {c}{k}' for k in range(_P))})" for s, c in ((1, "q"), (2, "t"), (3, "u"))) + ")"))
    held = rows.select("grp", "n", kinds.alias("x")).select("grp", "n", "x.*").groupBy("grp", "start").agg(*_sums([f"x{k}" for k in range(_P)]))
    held = _centre(held).select("grp", "start", *[F.col(f"m{k}").alias(f"e{k}") for k in range(_P)], *[F.col(f"s{j}{i}").alias(f"c{j}{i}") for j, i in _PAIRS])
    held = held.union(mid.selectExpr("grp", "0 AS start", *["0D"] * (_P + len(_PAIRS)))).join(near(mid), "grp")
    corr = lambda j, i: f"CASE WHEN start = 0 OR {i} = {j} THEN int({i} = {j}) ELSE coalesce(try_divide(c{j}{i}, sqrt(c{j}{j} * c{i}{i})), 0D) END"
    held = held.selectExpr("grp", "start", *[f"CASE WHEN start = 1 THEN e{k} ELSE m{k} END AS m{k}" for k in range(_P)], *[f"CASE WHEN start = 1 THEN c{j}{i} ELSE {corr(j, i)} * d{j} * d{i} END AS s{j}{i}" for j, i in _PAIRS])
    return _solve(held).withColumn("logdet", F.lit(float("inf"))).select(*_START)


def _concentrated(cells: DataFrame, now: DataFrame, near: Callable) -> DataFrame:
    """One step for each row of ``now``: mean and scaled covariance of the nearest COVER of its group, ties included."""
    # a histogram of some hundred rings for each start, not a sort of rows
    edge = cells.join(near(now), "grp").groupBy("grp", "start").agg(F.expr(f"int(ceil(percentile({_RING}, {COVER}D, n)))").alias("edge"), F.sum("n").alias("all"))
    taken = cells.join(near(now.join(near(edge), ["grp", "start"])), "grp").where(F.expr(f"{_RING} <= edge"))
    sums = taken.groupBy("grp", "start").agg(*_sums(_Q), (F.sum("n") / F.first("all")).alias("cover"))
    return _solve(_centre(sums, _SCALE)).select(*_START)


def estimates(cells: DataFrame) -> DataFrame:
    """(grp, m0.., l00.., logdet): the minimum-covariance-determinant estimate of each group of (grp, q0.., n)."""
    near = bounded(cells.select("grp").distinct(), GROUPS)
    now = Table(_starts(cells, near).withColumn("open", F.lit(True)), "mcd")
    for _ in range(STEPS):
        step = _concentrated(cells, now.df.where("open").drop("open"), near).select("grp", "start", F.struct(*_PARAMS, "logdet").alias("next"))
        met = now.df.join(near(step), ["grp", "start"], "left")
        falls = F.coalesce(F.col("next.logdet") < F.col("logdet") - 1e-9, F.lit(False))
        last, now = now, Table(met.select("grp", "start", *[F.when(falls, F.col(f"next.{c}")).otherwise(F.col(c)).alias(c) for c in (*_PARAMS, "logdet")], falls.alias("open")), "mcd")
        last.drop()
        if now.df.where("open").isEmpty():
            break
    best = now.df.groupBy("grp").agg(F.min(F.struct("logdet", "start", *_PARAMS)).alias("b"))
    return best.select("grp", *[F.col(f"b.{c}").alias(c) for c in _PARAMS], F.col("b.logdet").alias("logdet"))


def verdicts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, cut: float = CUT) -> DataFrame:
    """The columns ``keep`` and the statistics, base_failed, distance (squared; null if base_failed) and kept, one row a document.

    Null texts and empty ones have no words and fail the base rules. A null lang or
    source is a value of its own. Groups under ``least`` rows use their lang's estimate,
    then that of all rows, then (still fewer) none: such documents are kept.
    """
    part = lambda c: F.struct(F.col(c).isNull().alias("none"), F.coalesce(F.col(c), F.lit("")).alias("name"))
    names = [f"k{i}" for i in range(len(keep))]
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], part(lang).alias("lang"), part(source).alias("src"), F.col(text).alias("text"))
    seen = statistics(held, "text").drop("text").withColumn("base_failed", base_failed())
    seen = Table(seen.select("*", *vector()), "statistics").df
    q = [f"q{k}" for k in range(_P)]
    cells = seen.where("NOT base_failed").groupBy("lang", "src", *q).agg(F.count("*").alias("n"))
    nobody = F.struct(F.lit(True).alias("none"), F.lit("").alias("name"))
    level = lambda k, a, b: F.struct(F.lit(k).alias("level"), a.alias("lang"), b.alias("src"))
    grp = {2: level(2, F.col("lang"), F.col("src")), 1: level(1, F.col("lang"), nobody), 0: level(0, nobody, nobody)}
    cells = cells.select(F.explode(F.array(*grp.values())).alias("grp"), *q, "n").groupBy("grp", *q).agg(F.sum("n").alias("n"))
    cells = Table(cells, "cells").df
    big = Table(cells.groupBy("grp").agg(F.sum("n").alias("rows")).where(F.col("rows") >= least).select("grp"), "groups").df
    cells = Table(cells.join(bounded(big, GROUPS)(big), "grp", "left_semi"), "cells").df
    found = Table(estimates(cells), "estimates").df
    # the estimate of each (lang, source) that occurs: its own, else its lang's, else that of all
    pairs = seen.groupBy("lang", "src").agg(F.count("*").alias("rows"))
    wide = pairs.select("lang", "src", F.explode(F.array(*grp.values())).alias("grp")).join(found, "grp")
    chosen = wide.groupBy("lang", "src").agg(F.max(F.struct(F.col("grp.level").alias("level"), *_PARAMS)).alias("b")).select("lang", "src", *[F.col(f"b.{c}").alias(c) for c in _PARAMS])
    chosen = Table(chosen, "chosen").df
    out = seen.join(bounded(chosen, GROUPS)(chosen), ["lang", "src"], "left").withColumn("distance", F.when(~F.col("base_failed"), distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
