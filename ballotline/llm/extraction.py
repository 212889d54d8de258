"""Main-text extraction by gradient-boosted trees over DOM nodes with hierarchical decoding.

Every block element is a node with features of its subtree (text, link and tag densities,
counts), its names' tokens, those above it, its depth and its siblings. Boosted trees give
each node log odds of being part of the article. Decoding is a dynamic programme from the
leaves up: a subtree is either left out as a whole, or its root is taken and each child
decided likewise, whichever has the larger weighted sum of log odds. So nothing is taken below
an element that is left out, and an element with the article in it isn't left out.

The model learns from ``PAGES`` made-up pages with labelled elements (page_samples), always the
same, in some seconds on the driver; it is 100 trees of 31 cuts. Pages are read one at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import map_arrow
from .dom import Page, features
from .page_samples import sample

#: Made-up pages to learn from.
PAGES = 1500
SEED = 11
_CLIP = 5.0


def labelled(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, weights) of the nodes of made-up pages; nodes with more text of their own weigh more."""
    xs, ys, ws = [], [], []
    for k in range(pages):
        html, labels = sample(seed * 100_000 + k)
        page = Page(html)
        if len(page.tag) != len(labels) + 1:
            raise AssertionError(f"made-up page {k} reads as {len(page.tag) - 1} elements, it has {len(labels)}")
        xs.append(np.array(features(page)[1:], np.float32))
        ys += labels
        ws.append(1 + xs[-1][:, 1] / 3)
    return np.concatenate(xs), np.array(ys, float), np.concatenate(ws)


@lru_cache(1)
def model() -> Boosted:
    return Boosted(depth=5, trees=100).fit(*labelled(PAGES, SEED))


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Which nodes are taken: the best choice in which what is below a node left out is left out too."""
    n = len(page.tag)
    own = [0] * n
    for k, text in page.texts:
        own[k] += len(text)
    best = [0.0] * n
    for k in range(n - 1, 0, -1):
        gain = best[k] + (0.5 + math.log1p(own[k])) * max(-_CLIP, min(_CLIP, float(odds[k])))
        best[k] = max(gain, 0.0)
        best[page.parent[k]] += best[k]
    taken = [True] * n
    for k in range(1, n):
        taken[k] = taken[page.parent[k]] and (best[k] > 0 or page.tag[k] in ("html", "body"))
    return taken


def main_text(page: Page, odds: np.ndarray) -> str:
    taken = decode(page, odds)
    return "\n".join(text for k, text in page.texts if taken[k])


def _extractor(trees: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                pages = [Page(h) for h in part.column(part.num_columns - 1).to_pylist()]
                rows = [features(p) for p in pages]
                odds = trees.score(np.array([r for x in rows for r in x], np.float32))
                ends = np.cumsum([len(x) for x in rows])
                texts = [main_text(p, o) for p, o in zip(pages, np.split(odds, ends[:-1]))]
                rest = part.columns[:-1]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "text"])

    return run


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """One row a page: the columns ``keep``, text and n_chars (its code points).

    Blocks come in page order, one a line, white space inside them as single spaces. Null and
    empty pages, and pages without an article, give an empty text. Repeated rows give
    repeated results; other columns are ignored.
    """
    from pyspark.sql import types as T

    held = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(html).alias("__html"))
    schema = T.StructType([*held.drop("__html").schema.fields, T.StructField("text", T.StringType())])
    out = map_arrow(held, _extractor(model()), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", F.length("text").cast("long").alias("n_chars"))
