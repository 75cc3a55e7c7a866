"""Splits into train, valid and test.

The order behind a split is a seeded digest of the group, so any engine and any
partitioning gives the same parts.  Cumulative weights run over groups, never
over rows; a global window is only used where a group is a row of a small table
(documents, periods), and the row-level split uses the distributed rank.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapidary.functions.hashing import multiset_sums, order_key
from lapidary.functions.text import extract_signs, period_bucket
from lapidary.session import ranked_within, running_sum, stage

PARTS = ("train", "valid", "test")
RATIOS = {"train": 0.8, "valid": 0.1, "test": 0.1}


class SplitError(ValueError):
    """A split that cannot be made."""


def check_ratios(ratios: dict[str, float]) -> None:
    if set(ratios) != set(PARTS):
        raise SplitError(f"ratios must name exactly {PARTS}")
    if abs(sum(ratios.values()) - 1) > 1e-9:
        raise SplitError("ratios must sum to 1")


def check_parts(split: DataFrame) -> DataFrame:
    """Error if a part is empty; reads one row per part."""
    there = {r[0] for r in split.groupBy("part").count().collect()}
    missing = [p for p in PARTS if p not in there]
    if missing:
        raise SplitError(f"empty part: {', '.join(missing)}")
    return split


def assign_groups(groups: DataFrame, ratios: dict[str, float] | None = None, seed: int = 1337, label: str = "groups") -> DataFrame:
    """``(grp, w)`` -> ``(grp, part)`` by cumulative weight in seeded order.

    A group belongs to train while the weight up to and with it is within the
    train share (the first one always), then to valid, then to test: one that
    straddles a bound falls to the later part.  Null is a group of its own.
    """
    ratios = ratios or RATIOS
    check_ratios(ratios)
    ordered = groups.select("grp", "w", order_key(seed, label, F.coalesce(F.col("grp").cast("string"), F.lit("\x00"))).alias("__h"))
    # one row per group; the running sum is taken over range-partitioned blocks
    run = running_sum(ordered, ["__h", "grp"], "w", "cum")
    total = groups.agg(F.sum("w").alias("total"))
    g = run.crossJoin(F.broadcast(total))  # one row
    part = (
        F.when((F.col("cum") <= ratios["train"] * F.col("total")) | (F.col("cum") == F.col("w")), "train")
        .when(F.col("cum") <= (ratios["train"] + ratios["valid"]) * F.col("total"), "valid")
        .otherwise("test")
    )
    return g.select("grp", part.alias("part"))


def split_by_group(records: DataFrame, group: Column, ratios: dict[str, float] | None = None, seed: int = 1337, label: str = "groups") -> DataFrame:
    """``records`` with ``part``; all rows of a group get the same one."""
    r = records.withColumn("__g", group.cast("string"))
    parts = assign_groups(r.groupBy(F.col("__g").alias("grp")).agg(F.count("*").alias("w")), ratios, seed, label)
    return r.join(parts, F.col("__g").eqNullSafe(F.col("grp"))).drop("__g", "grp")


def split_document(records: DataFrame, ratios: dict[str, float] | None = None, seed: int = 1337) -> DataFrame:
    return split_by_group(records, F.col("doc_id"), ratios, seed, "document")


def split_random(records: DataFrame, ratios: dict[str, float] | None = None, seed: int = 1337, key: str = "ord") -> DataFrame:
    """Row-level split: the first round(n·train) rows in seeded order are train (ties to even), and so on; ``rank`` is the place in that order."""
    ratios = ratios or RATIOS
    check_ratios(ratios)
    r = ranked_within(records.withColumn("__h", order_key(seed, "random", F.col(key))), [], ["__h", key], "rank")
    n = records.agg(F.count("*").alias("__n"))
    a = F.bround(F.col("__n") * F.lit(ratios["train"]).cast("double"), 0)
    b = F.bround(F.col("__n") * F.lit(ratios["valid"]).cast("double"), 0)
    part = F.when(F.col("rank") < a, "train").when(F.col("rank") < a + b, "valid").otherwise("test")
    return r.crossJoin(F.broadcast(n)).withColumn("part", part).drop("__h", "__n")


def metadata_group(key: str) -> Column:
    """Absent key: ``unknown``; present but null: ``None``."""
    return F.when(F.map_contains_key("meta", key), F.coalesce(F.col("meta")[key], F.lit("None"))).otherwise("unknown")


def split_metadata(records: DataFrame, key: str, ratios: dict[str, float] | None = None, seed: int = 1337) -> DataFrame:
    if not records.where(F.map_contains_key("meta", key)).limit(1).count():
        raise SplitError(f"no record has {key}")
    return split_by_group(records, metadata_group(key), ratios, seed, f"metadata:{key}")


def split_period(records: DataFrame, ratios: dict[str, float] | None = None, seed: int = 1337, key: str = "dateNotBefore") -> DataFrame:
    """Whole centuries go to one part; needs three known ones."""
    bucket = period_bucket(F.col("meta")[key])
    known = records.select(bucket.alias("b")).where("b <> 'unknown'").distinct().limit(3).count()
    if known < 3:
        raise SplitError("needs at least 3 century buckets")
    return split_by_group(records, bucket, ratios, seed, "period")


def sign_ranks(records: DataFrame, field: str = "hieroglyphs") -> DataFrame:
    """``(sign, n_records, rank)``: signs by falling record count, then sign. Signs are an alphabet: few rows."""
    s = records.select(F.explode(extract_signs(F.col("fields")[field])).alias("sign"))
    n = s.groupBy("sign").agg(F.count("*").alias("n_records"))
    return n.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n_records"), "sign")) - 1)


def split_sign_heldout(
    records: DataFrame, field: str = "hieroglyphs", n_signs: int = 25, band: tuple[float, float] = (0.25, 0.75), ratios: dict[str, float] | None = None, seed: int = 1337
) -> tuple[DataFrame, DataFrame]:
    """``(records with part, held signs)``.

    ``n_signs`` signs of the middle band of frequency are held out: every record
    with one of them is test, the rest is split by document into train and valid.
    A text that is null or has no sign holds none.
    """
    ratios = ratios or RATIOS
    check_ratios(ratios)
    ranks = stage(sign_ranks(records, field), "signs")
    n = ranks.count()
    if not n:
        raise SplitError("no signs")
    lo, hi = int(band[0] * n), int(band[1] * n)
    held = ranks.where((F.col("rank") >= lo) & (F.col("rank") < hi)).orderBy(order_key(seed, "signs", F.col("sign")), "sign").limit(n_signs).select("sign")
    signs = [r[0] for r in held.collect()]  # n_signs rows
    if len(signs) < n_signs:
        raise SplitError(f"only {len(signs)} signs in the band")
    has = F.coalesce(F.arrays_overlap(extract_signs(F.col("fields")[field]), F.array(*map(F.lit, signs))), F.lit(False))
    test, rest = records.where(has).withColumn("part", F.lit("test")), records.where(~has)
    share = ratios["train"] / (ratios["train"] + ratios["valid"])
    return split_by_group(rest, F.col("doc_id"), {"train": share, "valid": 1 - share, "test": 0.0}, seed, "sign_rest").unionByName(test), held


def split_by_document_count(pairs: DataFrame, ratios: dict[str, float], seed: int = 1337) -> DataFrame:
    """Sizes by number of documents (rounded to even), not by rows."""
    check_ratios(ratios)
    docs = split_random(pairs.select("doc_id").distinct(), ratios, seed, "doc_id").select("doc_id", "part")
    return pairs.join(docs, "doc_id")


def split_version(split: DataFrame, ids: str = "sent_id") -> str:
    """12 hex of the bags of ids of the parts, combined map-side."""
    rows = split.groupBy("part").agg(*multiset_sums(F.sha2(F.col(ids).cast("string"), 256))).collect()  # a row per part
    return hashlib.sha256("\n".join(sorted("|".join(r) for r in rows)).encode()).hexdigest()[:12]


def apply_scheme(scheme: str, records: DataFrame, meta: dict, seed: int = 1337, max_norm_dist: float = 0.1) -> tuple[DataFrame, DataFrame | None]:
    """Dispatch by scheme name -> (records with part, report or None)."""
    from lapidary.operators.dedup import dedup_against_train

    if scheme == "random":
        return split_random(records, seed=seed).drop("rank"), None
    if scheme == "document_heldout":
        return split_document(records, seed=seed), None
    if scheme == "dedup":
        target = meta["translation_field"] if meta["kind"] == "parallel" else meta["primary_field"]
        return dedup_against_train(split_document(records, seed=seed), target, max_norm_dist)
    if scheme == "period_heldout":
        dated = records.where(F.map_contains_key("meta", "dateNotBefore")).limit(1).count()
        return (split_period(records, seed=seed) if dated else split_metadata(records, "period", seed=seed)), None
    if scheme == "sign_heldout":
        return split_sign_heldout(records, seed=seed)
    raise SplitError(f"unknown scheme {scheme}")


def write_split(split: DataFrame, path: str) -> None:
    """One folder per part, so a read of one part prunes the others."""
    split.write.mode("overwrite").partitionBy("part").parquet(path)
