"""Same or near-same records across splits (problem 3).

An evaluation passage of length n is affected if some training text of its
corpus is within k = n // 10 edits.  Exact copies are found by an equi-join on
the normalised text, the rest by :mod:`lapidary.operators.near_texts`, in shards
of (corpus, field, length band).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.functions.text import normalize_py
from lapidary.operators import near_texts as N
from lapidary.operators.near_texts import Block, Pattern, needed_coverage, pieces  # noqa: F401
from lapidary.session import stage

FIELDS = ("translation_de", "text")
PASSAGES, LETTERS, TEXTS, CHARS = N.PASSAGES, N.LETTERS, N.TEXTS, N.CHARS  # of a block and of a chunk
SHARD = ["corpus", "field", "band"]


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, corpus, part, field, value) -> (…, norm, h): h is the digest of corpus, field and norm; empty norms go."""
    for b in batches:
        norm = [normalize_py(v) for v in b.column(b.num_columns - 1).to_pylist()]
        keep = pa.array([bool(v) for v in norm], pa.bool_())
        key = zip(b.column(1).to_pylist(), b.column(3).to_pylist(), norm)
        h = [hashlib.md5("\x1f".join(k).encode("utf-8", "surrogatepass")).digest() if k[2] else None for k in key]
        names = b.schema.names[:-1] + ["norm", "h"]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(norm, pa.string()), pa.array(h, pa.binary())], names=names).filter(keep)


def write_blocks(passages: DataFrame, reach: DataFrame) -> tuple[str, DataFrame, list[tuple[int, int, int]]]:
    """Blocks of passages, chunks of training texts and the plan of both (corpora x fields x bands)."""
    return N.write_blocks(passages, reach, SHARD, (PASSAGES, LETTERS, TEXTS, CHARS))


def affected(records: DataFrame, parts: DataFrame, fields: tuple[str, ...] = FIELDS, train: str = "train") -> DataFrame:
    """``(field, ord, part, corpus)`` of evaluation records that occur, exactly or almost, in the training part.

    ``parts(ord, part)`` may repeat rows; a record without part is ignored, and
    of a record with several parts the least counts.  Null, absent and empty
    values, and values with an empty normal form, are never affected.  Values of
    fewer than ten characters are affected by exact copies only (k = 0).  Ties
    and repeated rows change nothing; empty tables give an empty result.
    """
    part = parts.where("part is not null and ord is not null").groupBy("ord").agg(F.min("part").alias("part"))
    r = records.select("ord", "corpus", F.map_filter("fields", lambda k, v: k.isin(*fields) & (F.coalesce(v, F.lit("")) != "")).alias("fields"))
    rows = r.where(F.size("fields") > 0).join(part, "ord").select("ord", "corpus", "part", F.explode("fields").alias("field", "value"))
    schema = "ord long, corpus string, part string, field string, norm string, h binary"
    norm = stage(rows.select("ord", "corpus", "part", "field", "value").mapInArrow(_normal, schema), "normal")
    is_train = F.col("part") == train
    texts = stage(
        norm.groupBy("corpus", "field", "h").agg(F.first("norm").alias("norm"), F.max(is_train).alias("tr"), F.max(~is_train).alias("ev")).withColumn("n", F.length("norm")), "texts"
    )
    exact = texts.where("tr and ev").select("h")
    passages = texts.where("ev and not tr and n >= 10").withColumn("band", N.band(F.col("n")))
    found = N.near(passages, N.reaching(texts.where("tr"), 0.1, 10), SHARD, 0.1, (PASSAGES, LETTERS, TEXTS, CHARS))
    return norm.where(~is_train).join(exact.unionByName(found), "h", "left_semi").select("field", "ord", "part", "corpus").distinct()


def overlap_report(found: DataFrame) -> DataFrame:
    """Affected records per part, corpus and field, with subtotals (null: all)."""
    return found.cube("part", "corpus", "field").agg(F.countDistinct("ord").alias("n_records"))
