"""Restoration scores, calibration, conformal sets, bootstrap and translation metrics."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapidary.session import ranked_within, running_sum, stage

# -- frequency bins and recall


def frequency_bins(counts: DataFrame, n_bins: int = 3) -> DataFrame:
    """``(sign, c)`` -> ``(sign, bin)`` by falling count, then sign; edges at ``n (i + 1) // bins`` (not equal tiles)."""
    names = ["frequent", "medium", "rare"] if n_bins == 3 else [f"bin{i}" for i in range(n_bins)]
    r = ranked_within(counts.withColumn("__neg", -F.col("c")), [], ["__neg", "sign"], "__r").crossJoin(F.broadcast(counts.agg(F.count("*").alias("__n"))))  # one row
    out = F.lit(names[-1])
    for i in reversed(range(n_bins - 1)):
        out = F.when(F.col("__r") < F.floor(F.col("__n") * (i + 1) / n_bins), names[i]).otherwise(out)
    return r.select("sign", out.alias("bin"))


def _weight(df: DataFrame) -> Column:
    """How many equal slots a row stands for: its column ``weight``, if there is one."""
    return F.col("weight").cast("long") if "weight" in df.columns else F.lit(1).cast("long")


def recall_at(slots: DataFrame, bins: DataFrame | None = None, ks: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """``slots(labels, truth)`` -> recall per bin and in all (``bin`` = null); signs without a bin are ``all``. A column ``weight`` counts equal slots."""
    pos = F.array_position("labels", F.col("truth"))
    s = slots.select("truth", _weight(slots).alias("w"), *[F.when((pos > 0) & (pos <= k), _weight(slots)).otherwise(0).alias(f"h{k}") for k in ks])
    s = s.join(bins, s["truth"] == bins["sign"], "left").withColumn("bin", F.coalesce("bin", F.lit("all"))) if bins is not None else s.withColumn("bin", F.lit("all"))
    per = s.groupBy("bin").agg(F.sum("w").alias("n"), *[F.sum(f"h{k}").alias(f"h{k}") for k in ks])
    return per.rollup("bin").agg(F.sum("n").alias("n_slots"), *[(F.sum(f"h{k}") / F.sum("n")).alias(f"recall_{k}") for k in ks])


def calibration_error(predictions: DataFrame, conf: str = "conf", correct: str = "correct", n_bins: int = 10) -> DataFrame:
    """Share-weighted |accuracy - confidence| over equal-width bins ``(lo, hi]``, the first one with 0. Bounds are compared, never computed from the value."""
    edges = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])
    b = F.aggregate(edges, F.lit(0), lambda s, e: s + (F.col(conf) > e).cast("int"))
    per = predictions.where(F.col(conf).between(0, 1)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(conf).alias("c"))
    total = predictions.agg(F.count("*").alias("total"))
    return per.crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("total") * F.abs(F.col("acc") - F.col("c"))).alias("ece"))  # one row


# -- conformal prediction


def conformal_score(labels: str = "labels", probs: str = "probs", truth: str = "truth") -> Column:
    """Probability up to and with the first label that is the truth, summed from the left; 1 if it is not there."""
    p = F.array_position(labels, F.col(truth)).cast("int")
    up = F.aggregate(F.slice(probs, 1, F.greatest(p, F.lit(1))), F.lit(0.0), lambda s, x: s + x)
    return F.when(p > 0, up).otherwise(1.0)


def conformal_threshold(points: DataFrame, target: float = 0.9) -> DataFrame:
    """``(qhat, n)``: with k = ceil((n + 1) c), the value at place k from 0 (the last one if k >= n). A column ``weight`` counts equal points."""
    if not 0 < target < 1:
        raise ValueError("target coverage must lie between 0 and 1")
    s = stage(points.groupBy(conformal_score().alias("s")).agg(F.sum(_weight(points)).alias("c")), "scores")  # a row per different score
    up = running_sum(s, ["s"], "c", "up").crossJoin(F.broadcast(s.agg(F.sum("c").alias("n"))))  # one row
    k = F.ceil((F.col("n") + 1) * F.lit(target))
    at = F.when(k < F.col("n"), F.ceil(k / F.col("n") * (F.col("n") - 1))).otherwise(F.col("n") - 1)
    return up.where((F.col("up") > at) & (F.col("up") - F.col("c") <= at)).select(F.col("s").alias("qhat"), "n")


def conformal_sets(points: DataFrame, qhat: DataFrame) -> DataFrame:
    """Coverage and set sizes: the shortest prefix whose probability reaches ``qhat``, the whole list if none does. A column ``weight`` counts equal points."""
    p = points.crossJoin(F.broadcast(qhat.select("qhat")))  # one row
    cum = F.aggregate(
        "probs", F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("n")), lambda s, x: F.struct(F.when(s["t"] >= F.col("qhat"), s["t"]).otherwise(s["t"] + x).alias("t"), (s["n"] + (s["t"] < F.col("qhat")).cast("int")).alias("n"))
    )
    n = F.when(F.size("probs") == 0, 0).otherwise(F.greatest(cum["n"], F.lit(1)))
    size = p.select(n.alias("n"), F.col("labels"), F.col("truth"), _weight(p).alias("w"))
    hit = F.array_contains(F.slice("labels", 1, F.greatest("n", F.lit(0))), F.col("truth"))
    all_ = F.sum("w")
    return size.agg(
        (F.sum(F.when(hit, F.col("w")).otherwise(0)) / all_).alias("coverage"), (F.sum(F.col("n") * F.col("w")) / all_).alias("mean_size"), F.percentile("n", 0.5, F.col("w")).alias("median_size"), F.coalesce(all_, F.lit(0)).alias("n")
    )


# -- bootstrap over documents


#: Documents whose sums are broadcast, some 60 MB at most; more are joined by a shuffle of the draws.
SUMS = 1 << 20


def _picks(stats: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """``(b, the sums of the document picked)``, a row per resample and slot.

    Documents are numbered from 0 by name and picked with replacement by digests
    of seed, resample and slot: n_boot x documents draws, whatever the path.
    """
    docs = stage(ranked_within(stats, [], ["doc_id"], "k").drop("doc_id"), "sums")
    n = docs.count()
    spark = stats.sparkSession
    draws = spark.range(n_boot * n if n > 1 else 0).select(F.floor(F.col("id") / n).alias("b"), F.pmod("id", F.lit(n)).alias("slot")) if n else spark.range(0).select(F.col("id").alias("b"), F.col("id").alias("slot"))
    h = F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("slot").cast("string")), 256), 1, 8)
    return draws.select("b", F.pmod(F.conv(h, 16, 10).cast("bigint"), F.lit(max(n, 1))).alias("k")).join(F.broadcast(docs) if n <= SUMS else docs, "k")


def block_bootstrap(rows: DataFrame, value: str, doc: str = "doc_id", n_boot: int = 1000, level: float = 0.95, seed: int = 1234) -> DataFrame:
    """``(point, low, high, n_docs)`` of the mean of ``value`` over resampled documents.

    The statistic is a ratio of sums, so a resample is a join of its picks with
    the documents' sums; no row is touched again.  Fewer than two documents are
    an error.  Bounds are linear interpolations of the resampled values.
    """
    s = rows.where(F.col(value).isNotNull()).groupBy(F.col(doc).alias("doc_id")).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    boot = _picks(s, n_boot, seed).groupBy("b").agg((F.sum("s") / F.sum("c")).alias("v"))
    a = (1 - level) / 2
    ci = boot.agg(F.percentile("v", a).alias("low"), F.percentile("v", 1 - a).alias("high"))
    point = s.agg((F.sum("s") / F.sum("c")).alias("point"), F.count("*").alias("n_docs"))
    ok = F.when(F.col("n_docs") >= 2, F.col("point")).otherwise(F.raise_error(F.lit("needs at least 2 documents")))
    return point.crossJoin(ci).select(ok.alias("point"), "low", "high", "n_docs")  # one row each


def paired_bootstrap(rows: DataFrame, a: str, b: str, doc: str = "doc_id", n_boot: int = 1000, level: float = 0.95, seed: int = 1234) -> DataFrame:
    """``(delta, low, high, p_value, significant)`` of mean(a) - mean(b) over the same picks.

    p is twice the share of resamples whose difference does not have the sign of
    the observed one, 1 at most (and 1 if that is zero).
    """
    s = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(doc).alias("doc_id")).agg(F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.count("*").alias("c"))
    boot = _picks(s, n_boot, seed).groupBy("b").agg(((F.sum("sa") - F.sum("sb")) / F.sum("c")).alias("d"))
    obs = s.agg(((F.sum("sa") - F.sum("sb")) / F.sum("c")).alias("delta"), F.count("*").alias("n_docs"))
    al = (1 - level) / 2
    r = boot.crossJoin(F.broadcast(obs)).agg(  # one row
        F.first("delta").alias("delta"), F.percentile("d", al).alias("low"), F.percentile("d", 1 - al).alias("high"), F.avg((F.col("d") * F.signum("delta") <= 0).cast("double")).alias("rev"), F.max("n_docs").alias("n_docs")
    )
    ok = F.when(F.col("n_docs") >= 2, F.col("delta")).otherwise(F.raise_error(F.lit("needs at least 2 documents")))
    return r.select(ok.alias("delta"), "low", "high", F.least(F.lit(1.0), 2 * F.col("rev")).alias("p_value"), ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"))


# -- translation metrics (Popović 2015, Papineni et al. 2002)


def _counted(h: list[str], r: list[str], n: int) -> tuple[int, int, int]:
    """Matched, hypothesis and reference n-grams."""
    a, b = (Counter(zip(*(t[i:] for i in range(n)))) for t in (h, r))
    return sum((a & b).values()), sum(a.values()), sum(b.values())


def _gram_stats(pairs: DataFrame, sides: list[tuple[str, Callable[[str], list[str]], int]]) -> DataFrame:
    """``(id, kind, n, m, h, r)`` per sentence, kind and order; no n-gram leaves its task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for i, hyp, ref in zip(pdf["id"], pdf["hyp"], pdf["ref"]):
                for kind, cut, orders in sides:
                    h, r = cut(hyp or ""), cut(ref or "")
                    rows += [(i, kind, n, *_counted(h, r, n)) for n in range(1, orders + 1)]
            yield pd.DataFrame(rows, columns=["id", "kind", "n", "m", "h", "r"])

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # counting is the costly part: use all cores
    return pairs.select(F.col("id").cast("long").alias("id"), "hyp", "ref").repartition(parts, "id").mapInPandas(run, "id long, kind string, n int, m long, h long, r long")


def _chars(t: str) -> list[str]:
    return list("".join(t.split()))


def _words(t: str) -> list[str]:
    """Words with one punctuation mark at either end taken off as a word."""
    out = []
    for w in t.split():
        if len(w) > 1 and w[-1] in string.punctuation:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in string.punctuation:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def chrf_stats(pairs: DataFrame, orders: int = 6, word_orders: int = 0) -> DataFrame:
    """Statistics of ``pairs(id, hyp, ref)`` for characters and, with ``word_orders``, words; null texts are empty."""
    return _gram_stats(pairs, [("c", _chars, orders)] + ([("w", _words, word_orders)] if word_orders else []))


def _f_score(stats: DataFrame, by: list[str], beta: float = 2.0) -> DataFrame:
    """Mean precision and recall over the orders that both sides have, then F-beta, times 100."""
    per = stats.groupBy(*by, "kind", "n").agg(F.sum("m").alias("m"), F.sum("h").alias("h"), F.sum("r").alias("r")).where("h > 0 and r > 0")
    pr = per.groupBy(*by).agg(F.avg(F.col("m") / F.col("h")).alias("p"), F.avg(F.col("m") / F.col("r")).alias("q"))
    f = F.when(F.col("p") + F.col("q") > 0, (1 + beta**2) * F.col("p") * F.col("q") / (beta**2 * F.col("p") + F.col("q"))).otherwise(0.0)
    return pr.select(*by, (100 * f).alias("chrf"))


def corpus_chrf(pairs: DataFrame, word_orders: int = 0) -> DataFrame:
    """chrF of ``pairs(id, hyp, ref)`` from summed statistics (word_orders = 2: chrF++)."""
    return _f_score(chrf_stats(pairs, word_orders=word_orders), [])


def sentence_chrf(pairs: DataFrame, word_orders: int = 0) -> DataFrame:
    """``(id, chrf)`` per sentence; sentences without common orders score 0."""
    s = _f_score(chrf_stats(pairs, word_orders=word_orders), ["id"])
    return pairs.select("id").distinct().join(s, "id", "left").select("id", F.coalesce("chrf", F.lit(0.0)).alias("chrf"))


# fixed values: how the standard evaluation scripts set punctuation apart
_APART = [(re.compile(p), r) for p, r in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "))]


def tokens_13a(t: str) -> list[str]:
    """Tokens of the standard evaluation scripts: punctuation apart, periods and commas kept inside numbers."""
    t = f" {t.strip()} "
    for p, r in _APART:
        t = p.sub(r, t)
    return t.split()


def corpus_bleu(pairs: DataFrame, max_order: int = 4) -> DataFrame:
    """BLEU of ``pairs(id, hyp, ref)``: summed clipped n-gram precisions, brevity penalty, exponential smoothing of orders without a match."""
    return _bleu(_gram_stats(pairs, [("b", tokens_13a, max_order)]), max_order)


def corpus_scores(pairs: DataFrame, max_order: int = 4) -> DataFrame:
    """``(chrf, chrf_plus, bleu)`` of ``pairs(id, hyp, ref)`` from one pass over the texts."""
    sums = _gram_stats(pairs, [("c", _chars, 6), ("w", _words, 2), ("b", tokens_13a, max_order)]).groupBy("kind", "n").agg(*[F.sum(c).alias(c) for c in ("m", "h", "r")])
    sums = stage(sums, "grams")  # a row per kind and order
    chrf = lambda kinds, name: _f_score(sums.where(F.col("kind").isin(*kinds)), []).withColumnRenamed("chrf", name)
    return chrf("c", "chrf").crossJoin(chrf("cw", "chrf_plus")).crossJoin(_bleu(sums.where("kind = 'b'"), max_order))  # one row each


def _bleu(stats: DataFrame, max_order: int) -> DataFrame:
    per = stats.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("m", "h", "r")])
    zeros = F.sum((F.col("m") == 0).cast("int")).over(W.orderBy("n").rowsBetween(W.unboundedPreceding, 0))  # max_order rows
    p = per.where("h > 0").withColumn("z", zeros)
    p = p.withColumn("lp", F.when(F.col("m") > 0, F.ln(F.col("m") / F.col("h"))).otherwise(F.ln(1 / (F.pow(F.lit(2.0), "z") * F.col("h")))))
    one = F.col("n") == 1
    s = p.agg(F.sum("lp").alias("lp"), F.count("*").alias("k"), F.sum("m").alias("m"), F.max(F.when(one, F.col("h"))).alias("hl"), F.max(F.when(one, F.col("r"))).alias("rl"))
    bp = F.when(F.col("hl") >= F.col("rl"), 0.0).otherwise(1 - F.col("rl") / F.col("hl"))
    return s.select(F.when((F.col("m") > 0) & (F.col("k") == max_order), 100 * F.exp(F.col("lp") / max_order + bp)).otherwise(0.0).alias("bleu"))


def collect_ranked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (id, label, prob) of one slot as a ranked list; for applyInPandas on slots of bounded size."""
    pdf = pdf.sort_values(["prob", "label"], ascending=[False, True])
    return pd.DataFrame({"id": [pdf["id"].iloc[0]], "labels": [list(pdf["label"])], "probs": [list(pdf["prob"])]})
