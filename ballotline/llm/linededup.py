"""Line dedup over content-defined chunks of lines.

Chunks. A rolling hash over the hashes of the last two lines ends a chunk where its
lowest bit is 0, so an inserted line moves boundaries only next to itself. A line of
``LONG`` words or more is a chunk of its own. Chunks of at least ``LEAST`` words, in two
lines or more (or one long line), may be removed; shorter ones are never touched.

Dedup. Of equal chunks the first by (id, place) stays, null ids last. Every task
first compares the bytes of its own chunks, so that a chunk held by a third of
all rows leaves it once for each ``HELD`` bytes of distinct chunks. These are shuffled by hash, sorted and read as a
stream; bytes decide, never hashes alone. What a partition removed by itself takes no
part in that and is dealt out by document. Rows alike in id and text are one document:
each gets the same result.

Memory: ``HELD`` bytes of distinct chunks and windows, one text, one chunk of a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

LONG = 16
LEAST = 12
WIDE = 256
#: Bytes of distinct chunks, with what an entry takes besides, that a task holds before it gives them to the shuffle.
HELD = 64 << 20
_ENTRY = 300
#: Places from here on are windows, below it chunks.
_WINDOWS = 1 << 30
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def chunks(text: str | None) -> list[tuple[str, bool, int]]:
    """(chunk, may it be removed, its lines) of a text; joined by line breaks they are the text. Null: none."""
    if text is None:
        return []
    out: list[tuple[str, bool, int]] = []
    held: list[str] = []
    words = last = 0

    def close() -> None:
        nonlocal held, words
        if held:
            out.append(("\n".join(held), words >= LEAST and (len(held) > 1 or words >= LONG), len(held)))
        held, words = [], 0

    digest = xxhash.xxh64_intdigest
    for line in text.split("\n"):
        n, h = len(line.split()), digest(line.encode("utf-8", "surrogatepass"))
        if n >= LONG:
            close()
            held, words = [line], n
            close()
        else:
            held.append(line)
            words += n
            # two lines' hashes, mixed so that every bit counts
            r = ((last * 3 + h) * _ODD) & _MASK
            if not (r >> 40) & 1:
                close()
        last = h
    close()
    return out


def windows(text: str | None) -> list[tuple[int, int, bytes]]:
    """(first line, last line, what is compared) of a text's windows, in order; those of long lines only are left out.

    A window that overlaps an equal one before it is compared with its distance from that, so that it doesn't count as its repeat.
    """
    if not text:
        return []
    at, size, form = [], [], []
    for k, line in enumerate(text.split("\n")):
        if n := len(line.split()):
            raw = line.encode("utf-8", "surrogatepass")
            at.append(k)
            size.append(n)
            form.append(b"\1" + blake2b(raw, digest_size=16).digest() if n >= LONG or len(raw) > WIDE else b"\0" + raw + b"\n")
    ranges = set()
    hi = words = 0
    for lo in range(len(at)):
        while hi < len(at) and (words < LEAST or hi - lo < 2):
            words += size[hi]
            hi += 1
        if words >= LEAST and hi - lo >= 2:
            ranges.add((lo, hi))
        words -= size[lo]
    lo = words = 0
    for hi in range(1, len(at) + 1):
        words += size[hi - 1]
        while words - size[lo] >= LEAST and hi - lo > 2:
            words -= size[lo]
            lo += 1
        if words >= LEAST and hi - lo >= 2:
            ranges.add((lo, hi))
    out, last = [], {}
    for lo, hi in sorted(ranges):
        if min(size[lo:hi]) < LONG:
            raw = b"".join(form[lo:hi])
            if lo < last.get(raw, (0, 0))[1]:
                raw += b"\2%d" % (lo - last[raw][0])
            else:
                last[raw] = (lo, hi)
            out.append((at[lo], at[hi - 1], raw))
    return out


def _units(text: str | None, runs: bool) -> Iterator[tuple[int, bytes]]:
    """(place, what is compared) of all that may be removed from a text."""
    for at, (chunk, may, _) in enumerate(chunks(text)):
        if may:
            yield at, b"c" + chunk.encode("utf-8", "surrogatepass")
    if runs:
        for k, (_, _, raw) in enumerate(windows(text)):
            yield _WINDOWS + k, b"w" + raw


def _locals(batches: Iterator[pa.RecordBatch], runs: bool, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """(id, key, text) rows in. Out: a row with bytes for every chunk, one without for what repeats one that is still held.

    A chunk that comes again after it was given out is given out again, and its place compared where the shuffle brings both.
    """
    first: dict[bytes, tuple] = {}
    gone: list[tuple] = []
    held = 0

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["id", "key", "at", "hash", "chunk"])

    def given() -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for raw, place in first.items():
            rows.append((None if place[0] else place[1], place[2], place[3], xxhash.xxh64_intdigest(raw) - (1 << 63), raw))
            size += len(raw)
            if len(rows) >= 4096 or size > 4 << 20:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    for b in batches:
        for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            for at, raw in _units(text, runs):
                place = (doc is None, doc or 0, key, at)
                if (other := first.get(raw)) is None:
                    first[raw] = place
                    held += len(raw) + _ENTRY
                elif place != other:  # a repeated row doesn't repeat itself
                    if place < other:
                        first[raw], place = place, other
                    gone.append((None if place[0] else place[1], place[2], place[3], None, None))
            if held > most:
                yield from given()
                first.clear()
                held = 0
            if len(gone) >= 4096:
                yield batch(gone)
                gone = []
    if gone:
        yield batch(gone)
    yield from given()


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (hash, place): out the places of those whose bytes came before, and of those without bytes."""
    now, first = None, {}
    for b in batches:
        out = []
        for k, (doc, key, at, h, chunk) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
            if chunk is None:
                out.append(k)
                continue
            if h != now:
                now, first = h, {}
            # a document that occurs in several partitions doesn't repeat itself
            if first.setdefault(chunk, (doc, key, at)) != (doc, key, at):
                out.append(k)
        if out:
            yield b.take(pa.array(out)).select(["id", "key", "at"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k, g = b.schema.get_field_index("__text"), b.schema.get_field_index("__gone")
        texts, lines, dropped, parts = [], [], [], []
        for text, gone in zip(b.column(k).to_pylist(), b.column(g).to_pylist()):
            cut = set(gone or ())
            lines.append(0 if text is None else text.count("\n") + 1)
            out, n = set(), 0
            if any(at >= _WINDOWS for at in cut):
                for at, (lo, hi, _) in enumerate(windows(text), _WINDOWS):
                    if at in cut:
                        out.update(range(lo, hi + 1))
            first = 0
            for at, (_, _, m) in enumerate(chunks(text) if cut else []):
                if at in cut:
                    out.update(range(first, first + m))
                n += any(j in out for j in range(first, first + m))
                first += m
            dropped.append(len(out))
            parts.append(n)
            texts.append("\n".join(x for j, x in enumerate(text.split("\n")) if j not in out) if cut else text)
        rest = [j for j in range(b.num_columns) if j not in (k, g)]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(j) for j in rest), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(parts, pa.int64())],
            names=[*(b.schema.names[j] for j in rest), "__text", "__lines", "__removed", "__chunks"],
        )


def _deduplicated(docs: DataFrame, id_col: str, text: str, runs: bool) -> DataFrame:
    """Columns c0.. of ``docs`` without the text, then __text, __lines, __removed and __chunks."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    c_id, c_text = names[docs.columns.index(id_col)], names[docs.columns.index(text)]
    held = docs.toDF(*names).withColumn("__key", F.xxhash64(c_text)).withColumn("__id", F.col(c_id).cast("long"))
    own = map_arrow(held.select("__id", "__key", c_text), partial(_locals, runs=runs), "id long, key long, at int, hash long, chunk binary")
    slot = F.coalesce(F.xxhash64("hash"), F.lit(0).cast("long"))
    slot = F.when(F.col("hash").isNull(), F.xxhash64("id", "key", "at")).otherwise(slot)
    met = own.repartition(slot).sortWithinPartitions("hash", F.col("id").asc_nulls_last(), "key", "at")
    gone = map_arrow(met, _repeats, "id long, key long, at int").groupBy("id", "key").agg(F.collect_set("at").alias("__gone"))
    on = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__key") == F.col("key"))
    joined = held.join(gone, on, "left").select(*[n for n in names if n != c_text], F.col(c_text).alias("__text"), "__gone")
    counts = [T.StructField(n, T.LongType()) for n in ("__lines", "__removed", "__chunks")]
    schema = T.StructType([*joined.drop("__text", "__gone").schema.fields, T.StructField("__text", T.StringType()), *counts])
    return map_arrow(joined, _without, schema)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", runs: bool = False) -> DataFrame:
    """(id, text, n_lines, n_removed_lines, n_removed_chunks) of every row, text without the removed chunks.

    With ``runs``, lines of repeated runs go as well, and n_removed_chunks counts the chunks of which lines are gone.

    Null texts stay null, empty ones empty; a text of which nothing is left is empty.
    Rows with a null id take part, after all others. Repeated rows get equal results. An
    empty table gives no rows; further columns are ignored, whatever their names.
    """
    out = _deduplicated(docs.select(F.col(id_col).alias(id_col), F.col(text).alias(text)), id_col, text, runs)
    return out.select(F.col("c0").alias(id_col), F.col("__text").alias(text), F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed_lines"), F.col("__chunks").alias("n_removed_chunks"))


def apply(docs: DataFrame, id_col: str = "doc_id", text: str = "text", runs: bool = False) -> DataFrame:
    """``docs``, every row and column, its texts without the removed chunks."""
    out = _deduplicated(docs, id_col, text, runs)
    return out.select(*[F.col("__text").alias(c) if c == text else F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
