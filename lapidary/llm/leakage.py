"""Evaluation texts leaking into training text (problem 8).

The test items form a BM25 inverted index; every training passage is a query.
The score an item must reach is its own: the least score that any run of
``run`` consecutive words of the item gives, so a passage that contains such a
run cannot stay below.  Contributions are divided by that score, which makes the
threshold 1 for all items.

Retrieval is block-max WAND: postings are cut into blocks of items; the sum of
the query terms' block maxima bounds every score of a block, blocks bounded
below 1 are skipped, the others are scored exactly.  What is retrieved is
verified: a run of the passage's words must be a run of the item's.

The index of a stated test set is broadcast in blocks of at most ``ITEMS`` items
and a table of ``DENSE`` cells; each block is one pass over the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.functions.text import normalize_py

K1, B = 1.2, 0.75
ITEMS = 5_000  # items of a broadcast index
BLOCK = 16  # items of a block
DENSE = 1 << 24  # cells of the table of block maxima, 64 MB: fewer items where they are long
PASSAGE = 256  # words of a passage


class Index:
    """Block-max index of ``(item_id, words)``; items shorter than ``run`` words cannot leak and are left out."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int) -> None:
        self.run, self.passage = run, max(PASSAGE, run)
        items = sorted((w[:1], i, w) for i, w in items if len(w) >= run)  # similar items fall into one block
        self.ids = [i for _, i, _ in items]
        words = [w for *_, w in items]
        n = len(words)
        df = Counter(t for w in words for t in set(w))
        mean = sum(map(len, words)) / max(n, 1)
        self.terms = {t: j for j, t in enumerate(df)}
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        n_blocks = -(-n // BLOCK)
        weight: list[dict[int, float]] = [{} for _ in self.terms]
        self.runs: list[set[tuple[str, ...]]] = []
        for i, w in enumerate(words):
            tf = Counter(w)
            score = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
            own = [tuple(w[j : j + run]) for j in range(len(w) - run + 1)]
            least = min(sum(score[t] for t in set(r)) for r in own) * (1 - 1e-6)
            self.runs.append(set(own))
            for t, s in score.items():
                weight[self.terms[t]][i] = s / least
        # postings by term; block maxima as a term x block table
        self.bound = np.zeros((len(self.terms), n_blocks), np.float32)
        self.off = np.zeros(len(self.terms) + 1, np.int64)
        self.off[1:] = np.cumsum([len(x) for x in weight])
        self.item = np.zeros(self.off[-1], np.int32)
        self.score = np.zeros(self.off[-1], np.float64)
        for j, x in enumerate(weight):
            at = sorted(x)
            self.item[self.off[j] : self.off[j + 1]] = at
            self.score[self.off[j] : self.off[j + 1]] = [x[i] for i in at]
            for i in at:
                self.bound[j, i // BLOCK] = max(self.bound[j, i // BLOCK], x[i])
        self.most = self.bound.max(axis=1) if n_blocks else np.zeros(len(self.terms), np.float32)

    def retrieve(self, words: list[str]) -> list[int]:
        """Items (by place) whose score for the query reaches the threshold."""
        terms = self.terms
        q = np.fromiter({terms[w] for w in words if w in terms}, np.int64)
        if not len(q) or self.most[q].sum() < 1 - 1e-4:
            return []
        blocks = np.flatnonzero(self.bound[q].sum(axis=0) >= 1 - 1e-4)
        out: list[int] = []
        if not len(blocks):
            return out
        # postings of the query terms inside the blocks that are left
        lens = self.off[q + 1] - self.off[q]
        at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(self.off[q], lens)
        it, sc = self.item[at], self.score[at]
        left = np.zeros(self.bound.shape[1], bool)
        left[blocks] = True
        ok = left[it // BLOCK]
        total = np.bincount(it[ok], weights=sc[ok], minlength=len(self.ids))
        return np.flatnonzero(total >= 1).tolist()

    def leaks(self, words: list[str]) -> list[int]:
        """Ids of the items that share a run with ``words``; passages overlap by run - 1 words, so no run is cut."""
        found: set[int] = set()
        step = self.passage - self.run + 1
        for lo in range(0, max(len(words) - self.run + 1, 1), step):
            part = words[lo : lo + self.passage]
            if len(part) < self.run:
                break
            cand = [i for i in self.retrieve(part) if i not in found]
            if cand:
                runs = set(zip(*(part[j:] for j in range(self.run))))
                found.update(i for i in cand if not runs.isdisjoint(self.runs[i]))
        return [self.ids[i] for i in found]


def _search(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    ix = index.value
    for b in batches:
        docs, items = [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for i in ix.leaks(normalize_py(text).split()):
                docs.append(doc)
                items.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])


def leaked_items(documents: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """``(doc_id, item_id)``: the words of the document contain ``run`` consecutive words of the item.

    Documents with null or empty text, and items with fewer than ``run`` words,
    are no cases.  Repeated rows of a document give one row.  Empty tables give
    an empty result.  Other columns of either table are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and text <> ''")
    rows = items.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator()  # the stated test set
    out, held, terms = None, [], set()

    def search(block):
        shared = spark.sparkContext.broadcast(Index(block, run))
        return docs.mapInArrow(lambda it: _search(it, shared), "doc_id long, item_id long")

    def plus(x, y):
        return y if x is None else x.unionByName(y)

    for r in rows:
        words = normalize_py(r[1]).split()
        if held and (len(held) == ITEMS or len(terms.union(words)) * (len(held) // BLOCK + 1) > DENSE):
            out, held, terms = plus(out, search(held)), [], set()
        held.append((r[0], words))
        terms.update(words)
    if held or out is None:
        out = plus(out, search(held))
    return out.distinct()


def leak_report(leaks: DataFrame, documents: DataFrame) -> DataFrame:
    """Leaked items and affected documents per source."""
    d = documents.select("doc_id", "source").distinct()
    return leaks.join(d, "doc_id").groupBy("source").agg(F.countDistinct("doc_id").alias("n_documents"), F.countDistinct("item_id").alias("n_items"))
