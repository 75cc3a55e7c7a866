"""Removal of evaluation rows that occur in the training part, exactly or almost.

A row of valid or test is near if a training text is within ``int(d · n)`` edits
of it, n being its own length; :mod:`lapidary.operators.near_texts` finds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.functions.text import normalize_target
from lapidary.operators.near_texts import allowed, band, near, reaching
from lapidary.session import stage

MOST = 1 << 20  # a distance of less than one edit in so many characters is none


def near_pairs(evals: DataFrame, trains: DataFrame, d: float = 0.1) -> DataFrame:
    """``evals(id, norm)`` and ``trains(id, norm)`` of distinct texts -> ``(id)`` of the evaluation texts with a near training text."""
    if not 0 <= d < 1:
        raise ValueError("the distance must be at least 0 and below 1")
    n = F.length("norm")
    least = next((x for x in range(1, MOST) if allowed(x, d) > 0), MOST)  # shorter ones have no edit
    e = evals.select(F.col("id").alias("h"), "norm", n.alias("n")).where(F.col("n") >= least).withColumn("band", band(F.col("n")))
    t = reaching(trains.select(F.col("id").alias("h"), "norm", n.alias("n")).where("n > 0"), d, least)
    return near(e, t, ["band"], d).select(F.col("h").alias("id"))


def dedup_flags(split: DataFrame, target: str, max_norm_dist: float = 0.1) -> DataFrame:
    """``split`` (records with ``part``) with ``removed``: null, ``exact`` or ``near``.

    Train is untouched.  The empty normal form can be an exact duplicate.  A
    record without the target field is an error; a null value counts as empty.
    """
    value = F.coalesce(F.col("fields")[target], F.lit(""))
    rows = stage(split.withColumn("__n", normalize_target(value)).withColumn("__id", F.unhex(F.md5("__n"))).withColumn("__has", F.map_contains_key("fields", target)), "normalised")
    if not rows.where("not __has").isEmpty():
        raise KeyError(f"a record has no field {target}")
    sides = F.max(F.col("part") == "train").alias("tr"), F.max(F.col("part") != "train").alias("ev")
    texts = stage(rows.groupBy(F.col("__id").alias("id")).agg(F.first("__n").alias("norm"), *sides), "texts")
    gone = texts.where("tr and ev").select("id", F.lit("exact").alias("removed"))
    if max_norm_dist > 0:
        gone = gone.unionByName(near_pairs(texts.where("ev and not tr"), texts.where("tr"), max_norm_dist).withColumn("removed", F.lit("near")))
    hit = rows.join(gone, F.col("__id") == F.col("id"), "left").drop("id", "__id", "__n", "__has")
    return hit.withColumn("removed", F.when(F.col("part") != "train", F.col("removed")))


def dedup_report(flags: DataFrame) -> DataFrame:
    """Per evaluation part: checked, removed exactly, removed as near, kept."""
    return (
        flags.where("part <> 'train'")
        .groupBy("part")
        .agg(F.count("*").alias("checked"), F.count_if(F.col("removed") == "exact").alias("removed_exact"), F.count_if(F.col("removed") == "near").alias("removed_near"), F.count_if(F.col("removed").isNull()).alias("kept"))
    )


def dedup_against_train(split: DataFrame, target: str, max_norm_dist: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """``(kept rows, report)``; an evaluation part that becomes empty is an error."""
    flags = stage(dedup_flags(split, target, max_norm_dist), "flags")
    report = dedup_report(flags)
    from lapidary.operators.splits import check_parts

    kept = flags.where("removed is null").drop("removed")
    check_parts(kept)
    return kept, report


def drop_known_lines(new: DataFrame, known: DataFrame, order: str | None = None) -> DataFrame:
    """Lines of ``new(line)`` whose trimmed text is not in ``known(line)``, once each, blank ones skipped; with ``order``, the first of equal ones stays."""
    key = F.trim("line")
    rows = new.where(key != "").withColumn("__k", key)
    rows = rows.groupBy("__k").agg(F.min_by(F.struct(*new.columns), order).alias("r")).select("__k", "r.*") if order else rows.dropDuplicates(["__k"])
    return rows.join(known.select(F.trim("line").alias("__k")).distinct(), "__k", "left_anti").drop("__k")
