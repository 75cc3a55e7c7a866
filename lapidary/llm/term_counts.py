"""Frequency of every distinct value or term (problem 7).

Each worker counts its terms in a burst trie: inner nodes branch by the next
character, leaves are small tables of (rest of the term -> occurrences, records)
that burst into a node when they grow.  The compact tries (one row per leaf)
are written once.  From the leaves' sizes alone the prefixes that must be routed
further are found, at most ``ROUTES`` per level, so a prefix that holds a third
of all terms is divided while a thin one stays whole.  A subtree that would still
hold more than ``SUBTREE`` entries (the terms that begin with one long prefix, or
any route where there are very many terms) is divided by a hash of the term, so
no task merges more at a time, whatever the data.  Matching subtrees meet by
their route and are merged there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.session import stage

BURST = 2_048  # terms of a leaf before it bursts
HELD = 400_000  # distinct terms a worker holds before it writes its trie and starts anew
ROUTES = 512
DEPTH = 12  # characters of the prefixes by which subtrees are routed
SUBTREE = 200_000  # entries of a subtree that is merged at a time, on average
_SIGN = re.compile("[\U00013000-\U0001345f]|<g>([^<]+)</g>")


def signs(v: str) -> list[str]:
    """Characters U+13000 to U+1345F and the contents of ``<g>…</g>``, in order, repeats kept."""
    return [m[1] if m[1] is not None else m[0] for m in _SIGN.finditer(v)]


TERMS: dict[str, Callable[[str], list[str]]] = {"hieroglyphs": signs, "text": str.split}


class BurstTrie:
    """Counters (occurrences, records) by term."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        self.root: dict = {}  # a leaf: rest -> [occurrences, records]; a node: {None: leaf of "", char: child}
        self.nodes: set[int] = set()
        self.size = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        at, i, parent, edge = self.root, 0, None, None
        while id(at) in self.nodes:
            c = term[i : i + 1]
            parent, edge = at, c
            at = at.get(c)
            if at is None:
                at = parent[c] = {}
            i += len(c)
            if not c:
                break
        rest = term[i:]
        x = at.get(rest)
        if x is None:
            at[rest] = [occurrences, records]
            self.size += 1
            if len(at) > self.burst and edge != "":
                self._burst(at, parent, edge)
        else:
            x[0] += occurrences
            x[1] += records

    def _burst(self, leaf: dict, parent: dict | None, edge: str | None) -> None:
        node: dict = {}
        for rest, x in leaf.items():
            node.setdefault(rest[:1], {})[rest[1:]] = x
        self.nodes.add(id(node))
        if parent is None:
            self.root = node
        else:
            parent[edge] = node

    def leaves(self) -> Iterator[tuple[str, dict]]:
        """(prefix, leaf) of all leaves."""
        todo = [("", self.root)]
        while todo:
            prefix, at = todo.pop()
            if id(at) in self.nodes:
                todo += [(prefix + c, child) for c, child in at.items()]
            elif at:
                yield prefix, at


_LEAF = "field string, prefix string, terms array<string>, occurrences array<long>, records array<long>"


def _rows(field: str, leaves: Iterator[tuple[str, dict]]) -> Iterator[pa.RecordBatch]:
    rows = [(field, p, list(x), [v[0] for v in x.values()], [v[1] for v in x.values()]) for p, x in leaves]
    if rows:
        cols = list(zip(*rows))
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["field", "prefix", "terms", "occurrences", "records"])


def _count(batches: Iterator[pa.RecordBatch], terms: dict[str, Callable[[str], list[str]]], burst: int, most: int) -> Iterator[pa.RecordBatch]:
    """(field, value) -> leaves of this worker's tries, plus a row with prefix null: the number of non-empty values."""
    tries: dict[str, BurstTrie] = {}
    filled: Counter = Counter()
    for b in batches:
        occ: dict[str, Counter] = {}
        rec: dict[str, Counter] = {}
        for field, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ts = terms[field](v)
            filled[field] += 1
            if ts:
                occ.setdefault(field, Counter()).update(ts)
                rec.setdefault(field, Counter()).update(set(ts))
        for field, o in occ.items():
            t, r = tries.setdefault(field, BurstTrie(burst)), rec[field]
            for term, n in o.items():
                t.add(term, n, r[term])
            if t.size > most:
                yield from _rows(field, t.leaves())
                tries[field] = BurstTrie(burst)
    for field, t in tries.items():
        yield from _rows(field, t.leaves())
    for field, n in filled.items():
        yield from _rows(field, iter([(None, {"": [0, n]})]))


def _route(batches: Iterator[pa.RecordBatch], burst: dict[str, dict[str, int]], total: dict[str, int], most: int, share: int) -> Iterator[pa.RecordBatch]:
    """Leaves -> leaves cut at the routes, the shortest prefix of a term that is not to be divided, and by hash where a route is too large.

    ``burst`` has the entries of the prefixes that are divided; any other route
    holds no more than the share 1 / ``share`` of its field's.
    """
    for b in batches:
        for field, prefix, terms, o, r in zip(*(c.to_pylist() for c in b.columns)):
            deep, cut = burst.get(field, {}), {}
            thin = -(-total.get(field, 0) // (share * most))
            for t, x, y in zip(terms, o, r):
                whole, i = prefix + t, 0
                while i < min(len(whole), DEPTH) and whole[:i] in deep:
                    i += 1
                n = -(-deep[whole[:i]] // most) if whole[:i] in deep else thin
                part = xxhash.xxh32_intdigest(whole.encode("utf-8", "surrogatepass")) % n if n > 1 else 0
                cut.setdefault((whole[:i], part), {})[whole[i:]] = (x, y)
            for part in sorted({p for _, p in cut}):
                for rows in _rows(field, ((k[0], v) for k, v in cut.items() if k[1] == part)):
                    yield rows.append_column("part", pa.array([part] * rows.num_rows, pa.int32()))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves sorted by (field, prefix, part) -> (field, term, occurrences, records); one of them is held at a time."""

    def flush(key, held):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key[0]] * len(held), pa.string()),
                pa.array([key[1] + t for t in held], pa.string()),
                pa.array([x[0] for x in held.values()], pa.int64()),
                pa.array([x[1] for x in held.values()], pa.int64()),
            ],
            names=["field", "term", "occurrences", "records"],
        )

    key, held = None, {}
    for b in batches:
        for field, prefix, terms, o, r, part in zip(*(c.to_pylist() for c in b.columns)):
            if (field, prefix, part) != key:
                if held:
                    yield flush(key, held)
                key, held = (field, prefix, part), {}
            for t, x, y in zip(terms, o, r):
                z = held.get(t)
                if z is None:
                    held[t] = [x, y]
                else:
                    z[0] += x
                    z[1] += y
    if held:
        yield flush(key, held)


def term_frequencies(records: DataFrame, rare: int = 2, common: float = 0.1, terms: dict[str, Callable[[str], list[str]]] | None = None) -> DataFrame:
    """``(field, term, occurrences, records, mark)`` of every term.

    ``mark`` is ``rare`` for terms in at most ``rare`` records, otherwise
    ``common`` for terms in more than the share ``common`` of the records whose
    field is neither null nor empty, otherwise null.  A null or empty value has
    no terms and does not count; a blank one counts but has no terms.  Every row
    counts, repeated ones too.  An empty table gives an empty result.
    """
    terms = terms or TERMS
    spark = records.sparkSession
    long = records.select(F.explode(F.map_filter("fields", lambda k, v: k.isin(*terms) & (F.coalesce(v, F.lit("")) != ""))).alias("field", "value"))
    burst, most = BURST, HELD
    leaves = stage(long.mapInArrow(lambda it: _count(it, terms, burst, most), _LEAF), "tries")
    # a row per field
    filled = {r[0]: r[1] for r in leaves.where("prefix is null").groupBy("field").agg(F.sum(F.element_at("records", 1))).collect()}
    body = leaves.where("prefix is not null")
    # prefixes under which more than 1 / ROUTES of a field's leaf entries lie: at most ROUTES per level
    sized = stage(body.groupBy("field", F.substring("prefix", 1, DEPTH).alias("prefix")).agg(F.sum(F.size("terms")).alias("n")), "sizes")
    total = {r[0]: r[1] for r in sized.groupBy("field").agg(F.sum("n")).collect()}
    share = F.lit(0)
    for f, n in total.items():
        share = F.when(F.col("field") == f, F.lit(max(n // ROUTES, 64))).otherwise(share)
    up = sized.select("field", "n", F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda i: F.substring("prefix", F.lit(1), i))).alias("p"))
    deep: dict[str, dict[str, int]] = {}
    for r in up.groupBy("field", "p").agg(F.sum("n").alias("n")).where(F.col("n") > share).collect():
        deep.setdefault(r[0], {})[r[1]] = r[2]
    limit, routes = SUBTREE, ROUTES
    routed = body.mapInArrow(lambda it: _route(it, deep, total, limit, routes), _LEAF + ", part int")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["field", "prefix", "part"]
    merged = routed.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_merge, "field string, term string, occurrences long, records long")
    many = F.lit(None).cast("double")
    for field, n_filled in filled.items():
        many = F.when(F.col("field") == field, F.lit(float(n_filled) * common)).otherwise(many)
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > many, "common")
    return merged.withColumn("mark", mark)
