"""Character statistics, n-gram baselines and frequency matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START = "\x02"
RESERVED = 4  # ids before the first character of a vocabulary


def chars(col: Column | str) -> Column:
    """Characters of a text; an empty text has none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(c, ""), lambda x: x != "")


def char_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(ch, c)``; null texts have no characters."""
    return texts.select(F.explode(chars(text)).alias("ch")).groupBy("ch").agg(F.count("*").alias("c"))


def char_frequencies(texts: DataFrame, alphabet: list[str], text: str = "text") -> DataFrame:
    """``(ch, pos, freq)`` relative over a fixed alphabet, zeros kept; an error if no character is of it."""
    a = texts.sparkSession.createDataFrame([(c, i) for i, c in enumerate(alphabet)], "ch string, pos int")
    n = F.broadcast(a).join(char_counts(texts, text), "ch", "left").select("ch", "pos", F.coalesce("c", F.lit(0)).alias("c"))
    total = F.sum("c").over(W.partitionBy())  # the alphabet is small
    checked = F.when(total > 0, F.col("c") / total).otherwise(F.raise_error(F.lit("no character of the alphabet")))
    return n.select("ch", "pos", checked.alias("freq"))


def rank_match(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(src, tgt)``: characters matched by rank of frequency; of equal ones the earlier in the alphabet comes first."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.row_number().over(W.orderBy(F.desc("freq"), "pos")).alias("r"), F.col("ch").alias(name))

    return ranked(source, "src").join(ranked(target, "tgt"), "r").select("src", "tgt")


def key_accuracy(predicted: DataFrame, key: DataFrame) -> DataFrame:
    """Share of right entries of ``(src, tgt)``; the inventories must be equal."""
    j = predicted.withColumnRenamed("tgt", "p").join(key.withColumnRenamed("tgt", "k"), "src", "full_outer")
    odd = F.max(F.col("p").isNull() | F.col("k").isNull())
    return j.agg(F.when(~odd, F.avg((F.col("p") == F.col("k")).cast("int"))).otherwise(F.raise_error(F.lit("inventories differ"))).alias("accuracy"))


def token_accuracy(pairs: DataFrame, hypothesis: str, reference: str) -> DataFrame:
    """Micro word accuracy; an error where the number of words differs."""
    h, r = F.split(F.trim(hypothesis), r"\s+"), F.split(F.trim(reference), r"\s+")
    ok = F.aggregate(F.zip_with(h, r, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    same = F.when(F.size(h) == F.size(r), ok).otherwise(F.raise_error(F.lit("word counts differ")))
    return pairs.agg((F.sum(same) / F.sum(F.size(r))).alias("accuracy"))


def unigram_entropy(train: DataFrame, evals: DataFrame, text: str = "text", alpha: float = 1.0) -> DataFrame:
    """Mean nats per character, ``p = (c + a) / (N + a (V + 1))`` with V distinct training characters; an empty evaluation is an error."""
    t = char_counts(train, text)
    n = t.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count("*").alias("V"))
    e = char_counts(evals, text).withColumnRenamed("c", "m").join(t, "ch", "left").crossJoin(F.broadcast(n))  # one row
    p = (F.coalesce("c", F.lit(0)) + alpha) / (F.col("N") + alpha * (F.col("V") + 1))
    ce = F.sum(-F.ln(p) * F.col("m")) / F.sum("m")
    return e.agg(F.when(F.count("*") > 0, ce).otherwise(F.raise_error(F.lit("empty evaluation"))).alias("ce"))


def bigrams(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(a, b, n)``: successor counts with a start symbol per text and no end symbol."""
    c = chars(text)
    pair = F.zip_with(F.concat(F.array(F.lit(START)), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))), c, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return texts.where(F.length(text) > 0).select(F.explode(pair).alias("p")).select("p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("n"))


def bigram_entropy(train: DataFrame, evals: DataFrame, text: str = "text", alpha: float = 0.5) -> DataFrame:
    """Mean nats per character given the one before; an unseen context gives ``1 / (V + 1)``."""
    t = bigrams(train, text).withColumnRenamed("n", "c")
    ctx = t.groupBy("a").agg(F.sum("c").alias("ctx"))
    v = t.agg(F.countDistinct("b").alias("V"))
    e = bigrams(evals, text).join(t, ["a", "b"], "left").join(ctx, "a", "left").crossJoin(F.broadcast(v))  # one row
    p = F.when(F.col("ctx").isNull(), 1 / (F.col("V") + 1)).otherwise((F.coalesce("c", F.lit(0)) + alpha) / (F.col("ctx") + alpha * (F.col("V") + 1)))
    ce = F.sum(-F.ln(p) * F.col("n")) / F.sum("n")
    return e.agg(F.when(F.count("*") > 0, ce).otherwise(F.raise_error(F.lit("empty evaluation"))).alias("ce"))


def char_vocabulary(texts: DataFrame, text: str = "text", order: str = "ord", size: int = 4096) -> DataFrame:
    """``(ch, id)``: the most frequent characters, ties by first appearance, behind the reserved ids."""
    c = texts.select(F.col(order).alias("o"), F.posexplode(chars(text)).alias("p", "ch"))
    top = c.groupBy("ch").agg(F.count("*").alias("n"), F.min(F.struct("o", "p")).alias("first")).orderBy(F.desc("n"), "first").limit(size)
    return top.select("ch", (F.row_number().over(W.orderBy(F.desc("n"), "first")) - 1 + RESERVED).alias("id"))  # at most `size` rows
