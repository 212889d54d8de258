"""What the corpus operators share: the shared folder, written tables, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tables import Written as Table
from ..operators.tables import new_path, remove, scratch

__all__ = ["SPACE", "WORD", "Table", "bounded", "map_arrow", "new_path", "quoted", "remove", "scratch", "spans_sql", "word_count"]

#: ASCII white space, which parts words in most contracts.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Matches joined to a list at a time, so that very many in one text aren't copied again for each.
_BLOCK = 256


def spans_sql(text: str, pattern: str) -> str:
    """SQL for ARRAY<STRUCT<s INT, e INT>>: where a regex matches a text, in code points from 0, in order. Both are SQL expressions."""
    inner = """aggregate(blk, named_struct('at', acc.at, 'out', cast(array() AS array<struct<s:int,e:int>>)),
        (a, x) -> named_struct('at', a.at + x.g + x.m, 'out', concat(a.out, array(named_struct('s', a.at + x.g, 'e', a.at + x.g + x.m)))))"""
    joined = f"""flatten(aggregate(
        transform(sequence(0, (size(z) - 1) div {_BLOCK}), b -> slice(z, b * {_BLOCK} + 1, {_BLOCK})),
        named_struct('at', 0, 'out', cast(array() AS array<array<struct<s:int,e:int>>>)),
        (acc, blk) -> element_at(transform(array({inner}), y -> named_struct('at', y.at, 'out', concat(acc.out, array(y.out)))), 1),
        acc -> acc.out))"""
    lengths = f"zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), (g, m) -> named_struct('g', coalesce(length(g), 0), 'm', coalesce(length(m), 0)))"
    # split gives one piece more than there are matches; the last pair is no match
    return f"""element_at(transform(array({lengths}), l ->
        CASE WHEN size(l) < 2 THEN cast(array() AS array<struct<s:int,e:int>>) ELSE element_at(transform(array(slice(l, 1, size(l) - 1)), z -> {joined}), 1) END), 1)"""


def quoted(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bounded(rows: DataFrame, most: int) -> Callable[[DataFrame], DataFrame]:
    """How to join with tables of a row for each of ``rows``: broadcast if there are at most ``most``, else merged.

    The count decides, not the size of files, since small files may hold many rows.
    """
    return F.broadcast if rows.limit(most + 1).count() <= most else lambda df: df.hint("merge")


def word_count(text: Column, word: str = WORD) -> Column:
    """Number of words of a text as LONG; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(word)), F.lit(0)).cast("long")


#: Rows in a batch between Spark and Python. Whole texts can be long, and the JVM, its Arrow buffers and Python each hold a batch.
BATCH_ROWS = 512
_LIMIT = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, f: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` over batches of at most BATCH_ROWS rows.

    Spark reads the limit when the result is computed, after this returns: it is set for the session, unless the session has a lower one.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_LIMIT, "0")) <= BATCH_ROWS:
        conf.set(_LIMIT, str(BATCH_ROWS))
    return df.mapInArrow(f, schema)
