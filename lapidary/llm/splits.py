"""Splits that keep related records together (problem 1).

Records of one document, and of documents with an editor in common, directly or
through further documents, form a group and get the same part.

Groups are balanced by largest differencing: the extreme weights of k equal
bins are combined again and again until one partition into k bins is left;
whole bins then go to the parts by the target shares.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapidary.llm.components import connected_components
from lapidary.session import ranked_within, stage

# fixed values: what an editor field says when it names nobody, as sorted distinct words
NOBODY = {
    "", "unknown", "unbekannt", "n", "n n", "nn", "a n", "na", "anon", "anonym", "anonymous", "anonymus", "none", "null", "nil",
    "nobody", "niemand", "not known", "nicht bekannt", "no name", "tba", "tbd", "x", "various", "diverse", "editor unknown", "a o", "k a", "o a", "and others", "al et",
}


def _fold(v: str) -> str:
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", v).casefold())


def document_key(v: str | None) -> str | None:
    """Equal for ids that agree after NFKC, ignoring case, blanks, punctuation and leading zeros of digit runs."""
    if v is None:
        return None
    t = "".join(c for c in _fold(v) if not (c.isspace() or unicodedata.category(c)[0] in "PZC"))
    return re.sub(r"(?<!\d)0+(?=\d)", "", t)


def editor_keys(v: str | None) -> list[str]:
    """Distinct editors of a ``;`` separated list, each as its sorted set of words; nobody is left out."""
    out = set()
    for one in (v or "").split(";"):
        t = "".join(" " if unicodedata.category(c)[0] in "PSZC" else c for c in _fold(one))
        k = " ".join(sorted(set(t.split())))
        if k not in NOBODY:
            out.add(k)
    return sorted(out)


@F.pandas_udf(T.StringType())
def _doc_key(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(document_key, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _editors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(editor_keys)


def record_groups(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of ``records(corpus, doc_id, meta, ord)``.

    Returns ``(docs, groups)``: ``docs(corpus, doc_id, lone, node, n, label)``, one
    row per stored (corpus, doc_id) with its document node and group label, and
    ``groups(label, n, n_pairs)``.  ``label`` is the smallest ``ord`` of the group.

    A record whose ``doc_id`` is null is a document of its own (``lone`` is then
    its ``ord``); its stored pair is (corpus, null).  A null or empty ``meta``
    names no editor.  Repeated rows count as records but change no group.  An
    empty table gives empty results.
    """
    r = records.select("corpus", "doc_id", F.col("meta")["authors"].alias("authors"), "ord")
    lone = F.when(F.col("doc_id").isNull(), F.col("ord"))
    raw = stage(r.groupBy("corpus", "doc_id", lone.alias("lone"), "authors").agg(F.min("ord").alias("ord"), F.count("*").alias("n")), "docs")
    ids = raw.groupBy("corpus", "doc_id", "lone").agg(F.min("ord").alias("ord"), F.sum("n").alias("n")).withColumn("key", _doc_key("doc_id"))
    nodes = ids.groupBy("corpus", "key", "lone").agg(F.min("ord").alias("node"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("key", "lone")]
    docs = stage(
        ids.alias("a").join(nodes.alias("b"), [F.col("a.corpus") == F.col("b.corpus"), *same]).select("a.corpus", "a.doc_id", "a.lone", "a.n", "b.node"), "ids"
    )
    # an editor is a star from each of its documents to the first of them
    named = raw.where(F.trim("authors") != "").withColumn("editor", F.explode(_editors("authors")))
    eq = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "lone")]
    ties = named.alias("a").join(docs.alias("b"), [F.col("a.corpus") == F.col("b.corpus"), *eq]).select("editor", "node").distinct()
    first = ties.groupBy("editor").agg(F.min("node").alias("hub"))
    edges = ties.join(first, "editor").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    cc = connected_components(edges)
    docs = stage(docs.join(cc, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    pairs = docs.select("label", "corpus", "doc_id").distinct().groupBy("label").agg(F.count("*").alias("n_pairs"))
    groups = docs.groupBy("label").agg(F.sum("n").alias("n")).join(pairs, "label")
    return docs, groups


def label_records(records: DataFrame, docs: DataFrame) -> DataFrame:
    """``(ord, <columns of docs>)`` for every record; the lookup side is one row per stored id."""
    cols = [c for c in docs.columns if c not in ("corpus", "doc_id", "lone")]
    r = records.select("corpus", F.coalesce("doc_id", F.lit("")).alias("d"), F.when(F.col("doc_id").isNull(), F.col("ord")).otherwise(-1).alias("l"), "ord")
    d = docs.select("corpus", F.coalesce("doc_id", F.lit("")).alias("d"), F.coalesce("lone", F.lit(-1)).alias("l"), *cols)
    return r.join(d, ["corpus", "d", "l"]).select("ord", *cols)


def linked_records(records: DataFrame) -> DataFrame:
    """``(ord, group_ord)`` of every record whose group holds two or more different stored (corpus, doc_id)."""
    docs, groups = record_groups(records)
    many = groups.where("n_pairs > 1").select("label")
    return label_records(records, docs.join(many, "label").select("corpus", "doc_id", "lone", F.col("label").alias("group_ord"))).distinct()


def largest_differencing(weights: list[tuple[int, object]], k: int) -> list[list[object]]:
    """Partition ``(weight, item)`` into ``k`` lists of nearly equal weight (k-way largest differencing).

    Each item starts as a tuple of k bins with one filled; the two tuples with
    the largest spread are combined, heaviest bins of one with lightest of the
    other, until one is left.
    """
    if not weights:
        return [[] for _ in range(k)]
    # what a bin holds is a pair of what it was combined from, opened in the end, so a step costs k and not the items
    heap = [(-w, tie, [(0, None)] * (k - 1) + [(w, (item,))]) for tie, (w, item) in enumerate(weights)]
    heapq.heapify(heap)
    for tie in range(len(heap), 2 * len(heap) - 1):
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted(((x + y, (p, q) if p and q else p or q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda t: t[0])
        low = both[0][0]
        heapq.heappush(heap, (low - both[-1][0], tie, [(w - low, held) for w, held in both]))
    return [_opened(held) for _, held in heap[0][2]]


def _opened(held: tuple | None) -> list[object]:
    out, todo = [], [held] if held else []
    while todo:
        x = todo.pop()
        if len(x) == 1:
            out.append(x[0])
        else:
            todo += x
    return out


def plan_bins(histogram: list[tuple[int, int]], shares: dict[str, float], k: int) -> tuple[list[tuple[int, int, int]], dict[int, str]]:
    """Bins for ``histogram`` of (weight, count) and the part of each bin.

    Equal weights cancel exactly: of ``count`` groups of one weight, ``count // k``
    go to each bin (by rank modulo k) and fewer than k are left, which largest
    differencing places.  Different weights of N records number at most
    sqrt(2 N), so the work here is bounded by k sqrt(2 N) and not by the groups.

    Returns ``[(weight, rank, bin)]`` of the left-over groups and ``{bin: part}``.
    """
    loads, rest = [0] * k, []
    for w, n in histogram:
        for b in range(k):
            loads[b] += w * (n // k)
        rest += [(w, (w, r)) for r in range(n - n % k, n)]
    placed = []
    for b, items in enumerate(largest_differencing(sorted(rest, reverse=True), k)):
        for w, r in items:
            loads[b] += w
            placed.append((w, r, b))
    total, filled, parts = sum(loads), dict.fromkeys(shares, 0), {}
    for b in sorted(range(k), key=lambda b: (-loads[b], b)):
        part = max(shares, key=lambda p: (shares[p] * total - filled[p], shares[p]))
        parts[b] = part
        filled[part] += loads[b]
    return placed, parts


def balanced_split(records: DataFrame, shares: dict[str, float] | None = None, bins: int = 20, seed: int = 1337) -> DataFrame:
    """``(ord, group_ord, part)``: every record with the part of its group.

    Groups are ranked within their weight by a seeded hash, so the result is the
    same for any partitioning.  Shares must sum to 1.  A group heavier than a
    part's share cannot be divided; it goes where the deficit is largest.  A
    null in any column is allowed (see :func:`record_groups`); an empty table
    gives an empty result.
    """
    shares = shares or {"train": 0.8, "valid": 0.1, "test": 0.1}
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    spark = records.sparkSession
    docs, groups = record_groups(records)
    g = groups.select("label", "n").withColumn("h", F.xxhash64(F.lit(seed), "label"))
    ranked = stage(ranked_within(g, ["n"], ["h", "label"]), "ranked_groups")
    hist = [(r[0], r[1]) for r in ranked.groupBy("n").count().orderBy("n").toLocalIterator()]
    placed, parts = plan_bins(hist, shares, bins)
    special = spark.createDataFrame(placed, "n long, rank long, bin int")
    part_of = F.create_map(*[x for b, p in parts.items() for x in (F.lit(b), F.lit(p))]) if parts else None
    out = ranked.join(special, ["n", "rank"], "left").withColumn("bin", F.coalesce("bin", (F.col("rank") % bins).cast("int")))
    out = out.select("label", (part_of[F.col("bin")] if part_of is not None else F.lit(None).cast("string")).alias("part"))
    return label_records(records, docs.join(out, "label").select("corpus", "doc_id", "lone", F.col("label").alias("group_ord"), "part")).distinct()


def split_report(split: DataFrame, records: DataFrame) -> DataFrame:
    """Records, groups and share of each part."""
    t = split.groupBy("part").agg(F.count("*").alias("n_records"), F.countDistinct("group_ord").alias("n_groups"))
    n = split.agg(F.count("*").alias("total"))
    return t.crossJoin(F.broadcast(n)).select("part", "n_records", "n_groups", F.round(F.col("n_records") / F.col("total"), 6).alias("share"))
