"""Mixing sources to target weights (problem 9).

The largest mixture is the one in which the scarcest source is repeated as often
as it may be; its size gives every source a budget of tokens.  Whole repeats of a
source come first.  The rest of a budget is a subset-sum problem over the counts
of documents by exact token length: every length gives its proportional number,
and a bounded-knapsack programme over the lengths fills what is left, to the
token where that is possible.  Which documents of a length are taken is a seeded
choice.  Lengths are few where documents are many, so the programme does not grow
with the documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.session import ranked_within, stage

RANGE = 1 << 18  # largest rest, in tokens, that the programme fills


def fill(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their sum comes close to ``budget`` without passing it.

    Lengths of 0 are never needed.  If the budget covers everything, all are
    taken.  On a miss up to ``RANGE`` tokens of the proportional start are given
    back and the programme runs again; a budget within ``RANGE`` is then filled
    by it alone, which comes as close as is possible.
    """
    got = _fill(counts, budget)
    if sum(n * k for n, k in got.items()) < budget:
        got = max(got, _fill(counts, budget, True), key=lambda x: sum(n * k for n, k in x.items()))
    return got


def _fill(counts: dict[int, int], budget: int, again: bool = False) -> dict[int, int]:
    left = {n: c for n, c in counts.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in left.items())
    if budget <= 0 or not left:
        return {}
    if budget >= total:
        return left
    take = {n: c * budget // total for n, c in left.items()}
    rest = budget - sum(n * k for n, k in take.items())
    # long documents first, until the rest is short enough for the programme
    goal = RANGE if again else min(4 * max(left), RANGE)
    for n in sorted(left, reverse=True):
        if rest <= goal:
            break
        k = min(left[n] - take[n], max(0, rest - goal) // n)
        take[n] += k
        rest -= n * k
    # on a miss: of every length an even share, then the short ones
    for share in ((RANGE - rest) // len(left), RANGE) if again else ():
        for n in sorted(left):
            k = max(0, min(take[n], min(share, RANGE - rest) // n))
            take[n] -= k
            rest += n * k
    # sums that can be reached, and for each the step that reached it first
    top = min(rest, RANGE)
    use = [n for n in sorted(left) if n <= top and left[n] > take[n]]
    if not use:
        return {n: k for n, k in take.items() if k}
    top -= top % math.gcd(*use)  # no sum of these lengths lies between
    mask, reach, steps, by = (1 << (top + 1)) - 1, 1, [], np.full(top + 1, -1, np.int32)
    for n in use:
        spare, size = left[n] - take[n], 1
        while spare > 0 and not reach >> top & 1:
            k = min(size, spare, max(top // n, 1))
            new = (reach << (n * k)) & mask & ~reach
            if new:
                bits = np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8)
                at = np.flatnonzero(bits)
                at = (at[:, None] * 8 + np.arange(8))[np.unpackbits(bits[at], bitorder="little").reshape(-1, 8).astype(bool)]
                by[at] = len(steps)
                steps.append((n, k))
                reach |= new
            spare, size = (spare - k, size * 2) if k == size else (0, size)
    at = reach.bit_length() - 1
    while at:
        n, k = steps[by[at]]
        take[n] += k
        at -= n * k
    return {n: k for n, k in take.items() if k}


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Histogram of one source -> how many documents of each length are taken once more."""
    extra = fill(dict(zip(pdf["tokens"].tolist(), pdf["n"].tolist())), int(pdf["rest"].iloc[0]))
    out = pdf[["source", "tokens", "repeats"]].copy()
    out["extra"] = [extra.get(t, 0) for t in pdf["tokens"]]
    return out


def budgets(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens of each source in the largest mixture (or one of ``total`` tokens, if that is smaller).

    A source without tokens gets nothing; the others keep their proportions.
    """
    use = {s: w for s, (w, _) in targets.items() if w > 0 and tokens.get(s, 0) > 0 and targets[s][1] > 0}
    if not use:
        return dict.fromkeys(targets, 0)
    weight = sum(use.values())
    most = min(targets[s][1] * tokens[s] / (w / weight) for s, w in use.items())
    most = min(most, total) if total is not None else most
    return {s: min(int(most * use[s] / weight), targets[s][1] * tokens[s]) if s in use else 0 for s in targets}


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1337) -> tuple[DataFrame, DataFrame]:
    """Selection and report of the mixture of ``documents(doc_id, source, tokens)``.

    ``targets(source, target_share, max_repeats)`` is small.  The selection is
    ``(doc_id, source, tokens, repeats)`` with repeats >= 1; the report has a row
    per target with the share reached.  Sources that are not listed, and
    documents with a null source, are not part of the mixture; null tokens count
    0.  A listed source without documents gets nothing and the shares of the
    others keep their proportions; the report shows the gap.  Empty tables give
    an empty selection.
    """
    spark = documents.sparkSession
    # the stated targets: a row per source
    want = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in targets.where("source is not null").groupBy("source").agg(F.sum("target_share"), F.max("max_repeats")).collect()}
    names = spark.createDataFrame([(s,) for s in want], "source string")
    docs = stage(documents.join(F.broadcast(names), "source").select("doc_id", "source", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")), "sized")
    hist = stage(docs.groupBy("source", "tokens").agg(F.count("*").alias("n")), "lengths")
    have = {r[0]: r[1] for r in hist.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens"))).collect()}  # a row per target
    budget = budgets(have, want, total)
    rows = [(s, b, b // have[s] if have.get(s) else 0, b % have[s] if have.get(s) else 0) for s, b in budget.items()]
    plan = spark.createDataFrame(rows, "source string, budget long, repeats long, rest long")
    per = hist.join(F.broadcast(plan), "source").groupBy("source").applyInPandas(_plan, "source string, tokens long, repeats long, extra long")
    ranked = ranked_within(docs.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")), ["source", "tokens"], ["h", "doc_id"])
    chosen = ranked.join(per, ["source", "tokens"]).withColumn("repeats", (F.col("repeats") + (F.col("rank") < F.col("extra")).cast("long")).cast("int"))
    chosen = stage(chosen.where("repeats > 0").select("doc_id", "source", "tokens", "repeats"), "mixture")
    used = chosen.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("repeats_used"))
    goal = spark.createDataFrame([(s, w, m, have.get(s, 0) or 0) for s, (w, m) in want.items()], "source string, target_share double, max_repeats int, available_tokens long")
    all_ = used.agg(F.sum("n_tokens").alias("all_tokens"))
    rep = goal.join(used, "source", "left").crossJoin(F.broadcast(all_))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    report = rep.select(
        "source", "target_share", "max_repeats", "available_tokens", zero("n_documents").alias("n_documents"), zero("repeats_used").alias("repeats_used"), zero("n_tokens").alias("n_tokens"),
        F.round(F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)), 9).alias("actual_share"),
    )
    return chosen, report
