"""Queries of the problems over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- 1: splits that keep related records together


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.splits import linked_records

    return linked_records(table(spark, d, "records"))


@query
def p1_split(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.splits import balanced_split

    return balanced_split(table(spark, d, "records"))


@query
def p1_split_report(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.splits import balanced_split, split_report

    r = table(spark, d, "records")
    return split_report(balanced_split(r), r)


# -- 2: visually identical text with different characters


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.lookalike import lookalike_pairs

    return lookalike_pairs(table(spark, d, "records"))


@query
def p2_consistent(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.lookalike import consistent_values

    return consistent_values(table(spark, d, "records")).select("field", "ord", "form", "changed")


# -- 3: same or near-same records across splits


def _affected(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lapidary.llm.cross_split import affected

    parts = table(spark, d, "split_parts").where((F.col("scheme") == "random") & (F.col("tag") == "v1"))
    return affected(table(spark, d, "records"), parts)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _affected(spark, d).select("field", "ord").distinct()


@query
def p3_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.cross_split import overlap_report

    return overlap_report(_affected(spark, d))


# -- 5: near-duplicate records with small edits


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.near_dup import similar_records

    return similar_records(table(spark, d, "records"))


@query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.near_dup import near_duplicate_groups

    return near_duplicate_groups(table(spark, d, "records"))


# -- 7: frequency of every distinct value or term


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.term_counts import term_frequencies

    return term_frequencies(table(spark, d, "records")).where("mark is not null").select("field", "term", "mark")


@query
def p7_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.term_counts import term_frequencies

    return term_frequencies(table(spark, d, "records"))


# -- 8: evaluation texts leaking into training text


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.leakage import leaked_items

    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p8_leak_report(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.leakage import leak_report

    return leak_report(p8_found(spark, d), table(spark, d, "documents"))


# -- 10: long exact spans shared between records


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.shared_spans import sharing_documents

    return sharing_documents(table(spark, d, "documents"))


# -- 4: token budget per source and language


@query
def p4_token_counts(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.tokens import all_texts, unigram_counter, with_tokens

    texts = all_texts(table(spark, d, "records"), table(spark, d, "documents"), table(spark, d, "corpora"))
    return with_tokens(texts, "text", unigram_counter(table(spark, d, "tokenizer_pieces")))


@query
def p4_token_cube(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.tokens import token_cube

    return token_cube(p4_token_counts(spark, d))


@query
def p4_bpe_token_counts(spark: SparkSession, d: str, vocabulary: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    from lapidary.llm.tokens import BPE_PATTERN, all_texts, bpe_counter, with_tokens

    texts = all_texts(table(spark, d, "records"), table(spark, d, "documents"), table(spark, d, "corpora"))
    return with_tokens(texts, "text", bpe_counter(vocabulary, BPE_PATTERN))


# -- 9: mixing sources to target weights


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from lapidary.llm.mixing import mixture
    from lapidary.llm.tokens import unigram_counter, with_tokens

    sized = with_tokens(table(spark, d, "documents").select("doc_id", "source", "text"), "text", unigram_counter(table(spark, d, "tokenizer_pieces")))
    return mixture(sized, table(spark, d, "mix_targets"))


@query
def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


@query
def p10_stretches(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.shared_spans import shared_stretches

    return shared_stretches(table(spark, d, "documents"))


@query
def p10_shared_share(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.llm.shared_spans import shared_share

    return shared_share(table(spark, d, "documents"))
