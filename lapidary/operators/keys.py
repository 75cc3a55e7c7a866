"""Keys and numbering over the order of a table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapidary.session import ranked_within


def with_ord(df: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """Consecutive numbers from 0 in the given order, without a global window."""
    return ranked_within(df, [], order, name).withColumn(name, F.col(name).cast("long"))


def unique_ids(df: DataFrame, id_col: str = "sent_id", order: str = "ord") -> DataFrame:
    """The first row of an id keeps it, the k-th becomes ``id#k``.

    Repeated ids are numbered by an exact distributed rank, so one id in a third
    of all rows is no single task.  ``x#2`` may be taken already: only families
    (the id without such an ending) in which an id is repeated *and* another ends
    like that are renumbered one by one, in order.
    """
    marked = df.withColumn("__base", F.regexp_replace(id_col, r"#\d+$", ""))
    ids = marked.groupBy(id_col, "__base").agg(F.count("*").alias("__n"))
    odd = ids.groupBy("__base").agg(F.max(F.col(id_col) != F.col("__base")).alias("__ends"), F.max("__n").alias("__n")).where("__ends and __n > 1").select("__base")
    free = marked.join(odd, "__base", "left_anti")
    again = ids.where("__n > 1").select(id_col)
    once = free.join(again, id_col, "left_anti").select(marked.columns)
    n = F.col("__rank") + 1
    more = ranked_within(free.join(again, id_col, "left_semi").select(marked.columns), [id_col], [order], "__rank")
    more = more.withColumn(id_col, F.when(n == 1, F.col(id_col)).otherwise(F.concat(id_col, F.lit("#"), n.cast("string")))).select(marked.columns)
    nulls = marked.where(F.col(id_col).isNull())

    def renumber(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, seen, out = pdf.sort_values(order), set(), []
        for s in pdf[id_col]:
            if s in seen:
                k = 2
                while f"{s}#{k}" in seen:
                    k += 1
                s = f"{s}#{k}"
            seen.add(s)
            out.append(s)
        pdf[id_col] = out
        return pdf

    rest = marked.join(odd, "__base", "left_semi").select(marked.columns)
    out = once.where(F.col(id_col).isNotNull()).unionByName(more.where(F.col(id_col).isNotNull())).unionByName(nulls)
    return out.unionByName(rest.groupBy("__base").applyInPandas(renumber, rest.schema)).drop("__base")


def first_seen_number(df: DataFrame, keys: list[Column], order: str = "ord", name: str = "number") -> DataFrame:
    """Number of a row's key by first appearance, from 1. Nulls are keys of their own.

    Only the distinct keys are numbered; rows get their number by a join.
    """
    named = df.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    cols = [f"__k{i}" for i in range(len(keys))]
    first = named.groupBy(*cols).agg(F.min(order).alias("__first"))
    numbered = ranked_within(first, [], ["__first"], name).select(*[F.col(c).alias(f"__r{c}") for c in cols], (F.col(name) + 1).alias(name))
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r{c}"))
    return named.join(numbered, cond).select(*df.columns, name)


def cohort_ids(df: DataFrame, corpus: str, meta_keys: tuple[str, ...] = ("dateNotBefore", "dateNotAfter", "authors"), width: int = 5, order: str = "ord") -> DataFrame:
    """``doc_id`` of dating cohorts: equal values of ``meta_keys``, an absent key being the empty string and a null staying null."""
    keys = [F.when(F.map_contains_key("meta", k), F.col("meta")[k]).otherwise(F.lit("")) for k in meta_keys]
    return first_seen_number(df, keys, order).withColumn("doc_id", F.format_string(f"{corpus}-d%0{width}d", "number")).drop("number")


def running_index(df: DataFrame, group: str, order: list[str], width: int = 5, name: str = "index") -> DataFrame:
    """Zero-based index within a group, as digits."""
    return ranked_within(df, [group], order, name).withColumn(name, F.lpad(F.col(name).cast("string"), width, "0"))


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows in a total order, nulls first, with their place; a bounded heap per task, no global sort of all rows."""
    return ranked_within(df.orderBy(*order).limit(n), [], order, "place")
