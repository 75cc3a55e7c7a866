"""Ingest statistics, catalogue joins and the corpus census."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.functions.text import token_count


def ingest_stats(records: DataFrame, corpora: DataFrame) -> DataFrame:
    """Per corpus: records, documents, white-space tokens of the primary field. Null documents count as one."""
    r = records.join(F.broadcast(corpora.select("corpus", "primary_field")), "corpus", "left")
    return r.groupBy("corpus").agg(
        F.count("*").alias("n_records"),
        (F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n_docs"),
        F.sum(token_count(F.col("fields")[F.col("primary_field")])).alias("n_tokens_primary"),
    )


def field_coverage(records: DataFrame) -> DataFrame:
    """Records per corpus and field; a key that is present counts whatever its value."""
    return records.select("corpus", F.explode(F.map_keys("fields")).alias("field")).groupBy("corpus", "field").agg(F.count("*").alias("n"))


def coverage_map(records: DataFrame) -> DataFrame:
    """:func:`field_coverage` as one sorted map per corpus."""
    c = field_coverage(records).groupBy("corpus").agg(F.sort_array(F.collect_list(F.struct("field", "n"))).alias("e"))  # fields: a handful
    return c.select("corpus", F.map_from_entries("e").alias("field_coverage"))


def census(corpora: DataFrame, manifests: DataFrame) -> DataFrame:
    """Registry left-joined to the manifests: status stub, ingested or pending."""
    m = manifests.withColumn("__there", F.lit(True))
    status = F.when(F.col("kind") == "stub", "stub").when(F.col("__there"), "ingested").otherwise("pending")
    return corpora.join(m, "corpus", "left").withColumn("status", status).drop("__there")


def census_markdown(table: DataFrame) -> str:
    """The census as a table; a row per corpus comes to the driver."""

    def num(x) -> str:
        return f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else "-"

    lines = ["# Corpus census", "", "| corpus | kind | status | sentences | documents | tokens (primary) | translation |", "|---|---|---|---|---|---|---|"]
    for r in table.orderBy("corpus").toLocalIterator():
        d = r.asDict()
        lines.append(f"| {d['corpus']} | {d['kind']} | {d['status']} | {num(d.get('n_records'))} | {num(d.get('n_docs'))} | {num(d.get('n_tokens_primary'))} | {d.get('translation_lang') or '-'} |")
    return "\n".join(lines) + "\n"


def extension_histogram(files: DataFrame) -> DataFrame:
    """``files(subset, path, length)`` -> per subset files, bytes and extensions by falling count; ``.DS_Store`` is skipped."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.regexp_extract(F.lower(name), r"^.+(\.[^.]*[^.])$", 1)
    f = files.where(name != ".DS_Store").withColumn("ext", F.when(ext == "", "<none>").otherwise(ext))
    per = f.groupBy("subset", "ext").agg(F.count("*").alias("n"), F.sum("length").alias("b"), F.min("path").alias("first"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "first", "ext", "n")))
    return per.groupBy("subset").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.map_from_entries(F.transform(order, lambda x: F.struct(x["ext"], x["n"]))).alias("by_extension"))


def present_only(entries: DataFrame, files: DataFrame, name: str = "image_name") -> tuple[DataFrame, DataFrame]:
    """``(entries with a file, number of entries without)``."""
    return entries.join(files.select(name).distinct(), name, "left_semi"), entries.join(files.select(name).distinct(), name, "left_anti").agg(F.count("*").alias("missing"))
