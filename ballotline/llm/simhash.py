"""SimHash near-duplicates by meet-in-the-middle ball hashing.

64-bit fingerprints link at ``RADIUS`` = 3 or fewer differing bits. Two balls of
half the radius meet only for an even radius, so the 64 bits are dealt into
three blocks and each block is left out in turn: if two fingerprints differ in
1 to 3 bits, leaving out a block that holds one of them leaves at most 2, and
their balls of radius 1 share a variant. A fingerprint thus emits
3 * (1 + 42 or 43) = 131 keys instead of the 1 + 64 + 2016 of a full ball of
radius 2. Keys are shuffled and sorted, and colliding pairs are verified.

A variant shared by more than ``DENSE`` fingerprints would give many pairs.
Its fingerprints go a second, exact way that needs no pairs: all variants in
the full 64-bit space, where balls meet only if the fingerprints link. By
parity, two fingerprints at distance 3 are one even and one odd. Even ones emit
radius 1, odd ones radius 2 with both bits in one half of the word (of three
bits two are in one half). In a bucket of an even variant all members link
pairwise (distance at most 2); in one of an odd variant all link to each even
member. So each bucket gives a star, of at most 2,081 rows, whatever a group's size.

Work and memory: one pass over the texts, 131 rows of 16 bytes for each
*distinct* fingerprint, at most 1,057 more for one in a dense place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, Table, map_arrow
from .components import components

RADIUS = 3
#: Most fingerprints at a variant whose pairs are compared one by one; more go the exact way without pairs.
DENSE = 64
SEED = 42
_BLOCKS = ((0, 22), (22, 43), (43, 64))


def fingerprint(text: str | None, n: int = 3) -> int:
    """The unsigned fingerprint of one text: majority bits of XXH64 over n-word shingles, repeats counted.

    Null, empty and blank texts: 0. Fewer than n words: the whole sequence is the one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    ends = ends[n - 1 :] or ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(ends), 1 << 15):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + (1 << 15)], ends[k : k + (1 << 15)])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(ends), bitorder="little").view("<u8")[0])


def _add_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k = b.schema.get_field_index("__text")
        fp = np.array([fingerprint(t) for t in b.column(k).to_pylist()], np.uint64).view(np.int64)
        rest = [j for j in range(b.num_columns) if j != k]
        yield pa.RecordBatch.from_arrays([*(b.column(j) for j in rest), pa.array(fp)], names=[*(b.schema.names[j] for j in rest), "__fp"])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row and its fingerprint ``__fp`` (LONG, the 64 bits as they are)."""
    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"))
    schema = T.StructType([f for f in narrow.schema.fields if f.name != "__text"] + [T.StructField("__fp", T.LongType())])
    return map_arrow(narrow, _add_fingerprints, schema)


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sql_longs(values: list[int]) -> str:
    return "array(" + ",".join(f"{_long(v)}L" if _long(v) != -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")"


def punctured_keys(fp: str = "fp") -> Column:
    """ARRAY<LONG> of the 131 variants; the left-out block of bits holds the block's number."""
    flips, keeps, tags = [], [], []
    for k, (lo, hi) in enumerate(_BLOCKS):
        out = ((1 << (hi - lo)) - 1) << lo
        for flip in [0, *(1 << j for j in range(64) if not lo <= j < hi)]:
            flips.append(flip)
            keeps.append(~out & ((1 << 64) - 1))
            tags.append(k << lo)
    zipped = f"arrays_zip({_sql_longs(flips)}, {_sql_longs(keeps)}, {_sql_longs(tags)})"
    return F.expr(f"transform({zipped}, s -> (({fp} ^ s['0']) & s['1']) | s['2'])")


def _gathered(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, fp) of small batches in arrays of ``least`` rows or a little more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if len(held) * BATCH_ROWS >= least:
            yield np.concatenate([x.column(0).to_numpy() for x in held]), np.concatenate([x.column(1).to_numpy() for x in held]).view(np.uint64)
            held = []
    if held:
        yield np.concatenate([x.column(0).to_numpy() for x in held]), np.concatenate([x.column(1).to_numpy() for x in held]).view(np.uint64)


def _pairs(dense: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (key, fp) rows in; out rows (a, b) of links, and (fp, null) for members of a dense variant.

        A link is left out if this partition's links connect its ends already.
        """
        parent: dict[int, int] = {}
        told: set[int] = set()

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for keys, fps in _gathered(batches):
            key = np.concatenate([key, keys])
            fp = np.concatenate([fp, fps])
            left, right, crowd = [], [], []
            for shift in range(1, dense + 1):
                same = np.flatnonzero(key[shift:] == key[:-shift]) if len(key) > shift else np.empty(0, int)
                if not len(same):
                    break
                x, y = fp[same], fp[same + shift]
                if shift == dense:  # more than ``dense`` rows share the key
                    crowd += [x, y]
                    break
                near = np.bitwise_count(x ^ y) <= RADIUS
                left.append(x[near])
                right.append(y[near])
            a, c = [], []
            if left:
                for x, y in np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0).tolist():
                    if (p := root(x)) != (q := root(y)):
                        parent[p] = q
                        a.append(x)
                        c.append(y)
            if crowd:  # every member of such a run is dense ``dense`` rows before or behind another
                for x in np.unique(np.concatenate(crowd)).tolist():
                    if x not in told:
                        told.add(x)
                        a.append(x)
                        c.append(None)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array([_long(x) for x in a], pa.int64()), pa.array([x if x is None else _long(x) for x in c], pa.int64())], names=["a", "b"])
            key, fp = key[-dense:], fp[-dense:]

    return run


def _dense_links(dense: DataFrame) -> DataFrame:
    """Links among the fingerprints of (fp), by whole balls and stars; exact for any crowding."""
    ones = [1 << j for j in range(64)]
    twos = [(1 << i) | (1 << j) for half in (range(32), range(32, 64)) for i in half for j in half if i < j]
    even = F.expr("bit_count(fp) % 2 = 0")
    flips = F.when(even, F.expr(_sql_longs([0, *ones]))).otherwise(F.expr(_sql_longs([0, *ones, *twos])))
    met = dense.select("fp", even.alias("even"), F.explode(flips).alias("flip")).select("fp", "even", F.expr("fp ^ flip").alias("v"))
    hub = F.expr("min(CASE WHEN even OR bit_count(v) % 2 = 0 THEN fp END) OVER (PARTITION BY v)")
    return met.select("fp", hub.alias("hub")).where("hub IS NOT NULL AND hub <> fp").select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def links(distinct_fp: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) of distinct fingerprints (fp) whose components are those of all pairs within 3 bits."""
    emitted = distinct_fp.select(F.explode(punctured_keys("fp")).alias("key"), "fp")
    found = Table(map_arrow(emitted.repartition("key").sortWithinPartitions("key", "fp"), _pairs(dense), "a long, b long"), "links")
    crowd = found.df.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    out = found.df.where("b IS NOT NULL")
    return out if crowd.isEmpty() else out.union(_dense_links(crowd))


def cluster(fps: DataFrame, key: str) -> DataFrame:
    """(__fp, least): for each distinct fingerprint of ``fps`` the smallest ``key`` reachable. Null keys never win."""
    each = Table(fps.groupBy("__fp").agg(F.min(key).alias("least")), "distinct-fp")
    comp = components(links(each.df.select(F.col("__fp").alias("fp"))))
    comp = Table(comp, "components").df
    rooted = each.df.join(comp, F.col("__fp") == F.col("node"), "left").select("__fp", "least", F.coalesce("root", "__fp").alias("root"))
    # only fingerprints with a link can share a root
    best = each.df.join(comp, F.col("__fp") == F.col("node")).groupBy("root").agg(F.min("least").alias("best"))
    return rooted.join(best, "root", "left").select("__fp", F.coalesce("best", "least").alias("least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    fingerprint: 16 lowercase hex digits; component_id: the smallest id reachable over
    links of at most 3 bits, its own included. Rows with a null id take part and get
    their component's smallest id, null if there is none. Null, empty and blank texts
    have fingerprint zero and link like others. Repeated rows give repeated results;
    other columns are ignored; an empty table gives no rows.
    """
    fps = Table(fingerprints(docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__t")), ["__id"], "__t"), "fingerprints").df
    found = cluster(fps, "__id")
    return fps.join(found, "__fp").select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component: that with the smallest id (null last), of repeated rows one."""
    names = docs.columns
    safe = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at = {n: f"c{k}" for k, n in enumerate(names)}
    held = safe.withColumn("__row", F.monotonically_increasing_id())
    t = Table(fingerprints(held.withColumn("__t", F.col(at[text])), [*safe.columns, "__row"], "__t"), "docs-fp").df
    order = t.select("__fp", F.struct(F.col(at[id_col]).isNull().alias("n"), F.col(at[id_col]).alias("i"), F.col("__row").alias("r")).alias("k"))
    chosen = cluster(order, "k").select(F.col("least.r").alias("__row")).distinct()
    return t.join(chosen, "__row", "left_semi").select(*[F.col(at[n]).alias(n) for n in names])
