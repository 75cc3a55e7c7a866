"""Messages delivered more than once (problem 6).

The identifiers seen so far are kept as immutable *runs* in a folder: per hash
prefix a sorted array of 16-byte identifiers, with the delivery that stays of
each.  An incoming batch is first deduplicated locally (one row per identifier,
combined map-side, so a message delivered in a third of all rows shuffles next to
nothing), then each prefix searches its arrays by bisection and writes what is
new as the next run.

Prefixes lengthen with the data, so that a task holds about ``PREFIX`` identifiers
of a run: a run keeps the number of bits it was written with, and its sorted
arrays are cut at longer prefixes where a later run has more.  Runs are merged in
tiers: when there are more than ``most_runs``, the last ones are merged with those
before them that are not much larger, so an identifier is written again about
log n times and not at every fourth batch.

A run covers a span of sequence numbers; a merged run covers those of its parts,
which are deleted.  A run without its success mark is ignored, so an ingest that
dies half way can be repeated.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.session import shared_root

SEGMENT = 1 << 16  # identifiers of one stored array
PREFIX = 1 << 20  # identifiers of a prefix, on average
BITS = 24  # of the longest prefix
LATE = (1 << 63) - 1
_RUN = "prefix int, ids binary, received array<long>, delivery array<long>"


def identifier(run_id: str = "run_id", status: str = "status", completed_at: str = "completed_at") -> Column:
    """128-bit identity of a message: ids ignoring case and surrounding white space, the instant in whole seconds.

    Null is a value of its own; a time that cannot be read is compared as text;
    a blank time is null.
    """

    def plain(c: str) -> Column:
        return F.coalesce(F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")), F.lit("\x00"))

    t = F.nullif(F.trim(F.col(completed_at)), F.lit(""))
    at = F.expr(f"try_to_timestamp(trim({completed_at}))")
    when = F.coalesce(F.floor(F.unix_micros(at) / 1_000_000).cast("string"), F.concat(F.lit("?"), F.lower(t)), F.lit("\x00"))
    return F.unhex(F.md5(F.concat_ws("\x1f", plain(run_id), plain(status), when)))


class MessageIndex:
    """The identifiers seen so far, in ``folder`` (default: a new one in the shared folder of the session)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, prefix_bits: int = 6, most_runs: int = 3) -> None:
        self.spark, self.bits, self.most_runs = spark, prefix_bits, most_runs
        self.folder = folder or f"{shared_root(spark)}/messages-{uuid.uuid4().hex[:8]}"

    # -- runs

    def _listed(self) -> list[tuple[int, int, int, int, str]]:
        """(first, last sequence number, bits, identifiers at most, path) of every finished run."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        out = []
        for s in fs.listStatus(p):
            m = re.fullmatch(r"run-(\d+)-(\d+)-(\d+)-(\d+)", s.getPath().getName())
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                out.append((*map(int, m.groups()), s.getPath().toString()))
        return out

    def runs(self) -> list[tuple[int, int, int, int, str]]:
        """Runs that hold: those no wider run covers, in order."""
        all_ = self._listed()
        return sorted(r for r in all_ if not any(o is not r and o[0] <= r[0] and r[1] <= o[1] and o[:2] != r[:2] for o in all_))

    def _path(self, first: int, last: int, bits: int, n: int) -> str:
        return f"{self.folder}/run-{first:06d}-{last:06d}-{bits:02d}-{n}"

    def _bits(self, n: int) -> int:
        return min(max(self.bits, (-(-n // PREFIX)).bit_length()), BITS)

    def _read(self, runs: list[tuple], bits: int) -> DataFrame:
        """Rows of ``runs`` by prefixes of ``bits`` bits; no run has more."""
        out = None
        for own in sorted({r[2] for r in runs}):
            part = self.spark.read.schema(_RUN).parquet(*[r[4] for r in runs if r[2] == own])
            if own < bits:
                part = part.mapInPandas(lambda it: (_cut(pdf, bits) for pdf in it), _RUN)
            out = part if out is None else out.unionByName(part)
        return out

    def keepers(self) -> DataFrame:
        """``(delivery_id)`` of the delivery that stays, of every message; to be used before the next batch comes in."""
        self.merge()
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "delivery_id long")
        return self._read(runs, runs[0][2]).select(F.explode("delivery").alias("delivery_id"))

    def merge(self, last: int | None = None) -> None:
        """Merge the ``last`` runs (default: all) into one that covers them, and delete them."""
        runs = self.runs()[-last:] if last else self.runs()
        if len(runs) < 2:
            return
        n = sum(r[3] for r in runs)
        bits = max(self._bits(n), *(r[2] for r in runs))
        path = self._path(runs[0][0], runs[-1][1], bits, n)
        self._read(runs, bits).groupBy("prefix").applyInPandas(_merge, _RUN).write.mode("overwrite").parquet(path)
        for r in runs:
            if r[4].rstrip("/").rsplit("/", 1)[-1] != path.rsplit("/", 1)[-1]:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(r[4])
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def ingest(self, batch: DataFrame) -> None:
        """Add ``batch(id, received_at, delivery_id)``.

        Of one message the earliest ``received_at`` stays, of equals the smallest
        ``delivery_id``; a null ``received_at`` counts as the latest.  A batch may
        arrive twice and in any order: the result is the same.
        """
        runs = self.runs()
        at = F.coalesce(F.unix_micros("received_at"), F.lit(LATE))
        local = batch.groupBy("id").agg(F.min(F.struct(at.alias("received"), F.col("delivery_id").cast("long").alias("delivery"))).alias("k"))
        n = batch.count()
        bits = max(self._bits(n + sum(r[3] for r in runs)), *(r[2] for r in runs), self.bits)
        prefix = F.shiftright(F.conv(F.hex(F.substring("id", 1, 3)), 16, 10).cast("int"), BITS - bits)
        new = local.select(prefix.alias("prefix"), "id", "k.received", "k.delivery")
        if runs:
            out = new.groupBy("prefix").cogroup(self._read(runs, bits).groupBy("prefix")).applyInPandas(_novel, _RUN)
        else:
            out = new.groupBy("prefix").applyInPandas(_run, _RUN)
        seq = max((r[1] for r in runs), default=-1) + 1
        out.write.mode("overwrite").parquet(self._path(seq, seq, bits, n))
        runs = self.runs()
        if len(runs) > self.most_runs:
            k, size = 2, runs[-1][3] + runs[-2][3]
            while k < len(runs) and runs[-k - 1][3] <= 2 * size:
                k, size = k + 1, size + runs[-k - 1][3]
            self.merge(k)


def _cut(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Stored arrays cut at prefixes of ``bits`` bits; identifiers are sorted, so each prefix is a stretch."""
    out = [_segments(0, np.zeros(0, "S16"), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for ids, received, delivery in _arrays(pdf):
        head = np.frombuffer(ids.tobytes(), np.uint8).reshape(-1, 16)[:, :3].astype(np.int64)
        prefix = (head[:, 0] << 16 | head[:, 1] << 8 | head[:, 2]) >> (BITS - bits)
        cuts = np.flatnonzero(np.diff(prefix)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
            out.append(_segments(int(prefix[lo]), ids[lo:hi], received[lo:hi], delivery[lo:hi]))
    return pd.concat(out, ignore_index=True)


def _segments(prefix: int, ids: np.ndarray, received: np.ndarray, delivery: np.ndarray) -> pd.DataFrame:
    """Sorted arrays in stored form."""
    cuts = range(0, len(ids), SEGMENT)
    cut = lambda x: pd.Series([x[i : i + SEGMENT] for i in cuts], dtype=object)
    return pd.DataFrame(
        {
            "prefix": pd.Series([prefix] * len(cuts), dtype="int32"),
            "ids": pd.Series([ids[i : i + SEGMENT].tobytes() for i in cuts], dtype=object),
            "received": cut(received),
            "delivery": cut(delivery),
        }
    )


def _arrays(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for ids, received, delivery in zip(pdf["ids"], pdf["received"], pdf["delivery"]):
        yield np.frombuffer(ids, "V16").view("S16"), np.asarray(received, np.int64), np.asarray(delivery, np.int64)


def _sorted(ids: np.ndarray, received: np.ndarray, delivery: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per identifier, the earliest, by identifier."""
    order = np.lexsort((delivery, received, ids))
    ids, received, delivery = ids[order], received[order], delivery[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], received[first], delivery[first]


def _batch(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(pdf["id"]), "V16").view("S16")
    return _sorted(ids, pdf["received"].to_numpy(), pdf["delivery"].to_numpy())


def _run(pdf: pd.DataFrame) -> pd.DataFrame:
    return _segments(int(pdf["prefix"].iloc[0]), *_batch(pdf))


def _novel(pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """What a batch adds to one prefix: unknown identifiers, and known ones that arrived earlier than known."""
    if not len(pdf):
        return _segments(0, np.zeros(0, "S16"), np.zeros(0, np.int64), np.zeros(0, np.int64))
    ids, received, delivery = _batch(pdf)
    keep = np.ones(len(ids), bool)
    for known, r, d in _arrays(held):
        at = np.searchsorted(known, ids)
        at[at == len(known)] = 0
        hit = known[at] == ids
        earlier = (received < r[at]) | ((received == r[at]) & (delivery < d[at]))
        keep &= ~hit | earlier
    return _segments(int(pdf["prefix"].iloc[0]), ids[keep], received[keep], delivery[keep])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = list(_arrays(pdf))
    return _segments(int(pdf["prefix"].iloc[0]), *_sorted(*(np.concatenate(x) for x in zip(*parts))))


def surplus_deliveries(deliveries: DataFrame, rounds: int = 4, index: MessageIndex | None = None) -> DataFrame:
    """``(delivery_id)`` of every delivery beyond the one that stays of its message.

    The table is ingested in ``rounds`` spans of ``batch_id`` (null: the first),
    as it would have arrived.  ``delivery_id`` is unique, so the join that takes
    the keepers away has no hot key.  An empty table gives an empty result.
    """
    spark = deliveries.sparkSession
    index = index or MessageIndex(spark)
    lo, hi = deliveries.agg(F.min("batch_id"), F.max("batch_id")).first()
    lo, hi = lo or 0, hi or 0
    span = F.coalesce(F.floor((F.col("batch_id") - lo) * rounds / (hi - lo + 1)), F.lit(0)).cast("int")
    rows = deliveries.select(identifier().alias("id"), "received_at", "delivery_id", span.alias("span"))
    folder = f"{shared_root(spark)}/deliveries-{uuid.uuid4().hex[:8]}"
    rows.write.partitionBy("span").parquet(folder)  # the table is read once, a batch reads its own span
    rows = spark.read.schema(rows.schema).parquet(folder)
    for i in range(rounds):
        index.ingest(rows.where(F.col("span") == i).drop("span"))
    return deliveries.select("delivery_id").join(index.keepers(), "delivery_id", "left_anti").distinct()
