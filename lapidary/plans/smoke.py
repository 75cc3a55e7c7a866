"""End-to-end smoke: a toy cipher corpus is generated, split by document, solved by frequency and scored.

The chain touches generation, splits, frozen reads, statistics, decoding and
evaluation, and leaves a run in the ledger.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.functions.hashing import derive_seed
from lapidary.functions.text import encipher
from lapidary.operators import language as G
from lapidary.operators import splits as S
from lapidary.operators.integrity import Store, run_context
from lapidary.operators.ledger import Ledger

SOURCE, TARGET = "abcdefghijkl", "ABCDEFGHIJKL"
RATIOS = {"train": 0.7, "valid": 0.15, "test": 0.15}


class SmokeError(RuntimeError):
    """The chain ran but fell below its floor."""


def toy_corpus(spark: SparkSession, seed: int = 1337, sentences: int = 240, per_doc: int = 8, types: int = 40) -> tuple[DataFrame, dict[str, str]]:
    """``(pairs(doc_id, ord, src, tgt), key)``: sentences over a small vocabulary of skewed letters, and their images under a letter cipher."""
    rng = np.random.default_rng(derive_seed(seed, "toy"))
    key = dict(zip(SOURCE, rng.permutation(list(TARGET)).tolist()))
    weight = 0.72 ** np.arange(len(SOURCE))
    letters = rng.permutation(list(SOURCE))
    words = ["".join(rng.choice(letters, size=rng.integers(2, 7), p=weight / weight.sum())) for _ in range(types)]
    rows = [(f"toy-{i // per_doc:03d}", i, " ".join(rng.choice(words, size=rng.integers(3, 9)))) for i in range(sentences)]
    df = spark.createDataFrame(rows, "doc_id string, ord long, src string")
    return df.withColumn("tgt", encipher("src", key)), key


def solve(train: DataFrame) -> DataFrame:
    """``(src, tgt)``: letters of both sides matched by rank; the sides of a row need not be parallel."""
    return G.rank_match(G.char_frequencies(train, list(TARGET), "tgt"), G.char_frequencies(train, list(SOURCE), "src"))


def run_smoke(spark: SparkSession, root: str, seed: int = 1337, floor: float = 0.5) -> dict[str, float | str]:
    """Run the chain under ``root``; an error if the share of right letters is below ``floor``."""
    pairs, key = toy_corpus(spark, seed)
    split = S.check_parts(S.split_by_document_count(pairs, RATIOS, seed))
    store = Store(spark, root)
    if store.key("toy", "document", "v1") not in store.manifest():
        store.write(split, "toy", "document")
    digest = store.freeze("toy", "document")
    ledger = Ledger(spark, f"{root}/ledger")
    with ledger.run("smoke", "letters can be matched by frequency", seed, phase="phase0", selection_metric="key_accuracy") as (run_id, metrics):
        found = {r[0]: r[1] for r in solve(store.read("toy", "document", part="train")).collect()}  # an alphabet
        truth = spark.createDataFrame([(v, k) for k, v in key.items()], "src string, tgt string")
        guess = spark.createDataFrame(list(found.items()), "src string, tgt string")
        metrics["key_accuracy"] = G.key_accuracy(guess, truth).first()[0]
        with run_context(run_id):
            for part in ("valid", "test"):
                rows = store.read("toy", "document", part=part).select("src", encipher("tgt", found).alias("hyp"))
                metrics[f"{part}_accuracy"] = G.token_accuracy(rows, "hyp", "src").first()[0]
        if metrics["key_accuracy"] < floor:
            raise SmokeError(f"key accuracy {metrics['key_accuracy']:.3f} is below {floor}")
    if not store.audit().where(F.col("run_id") == run_id).count():
        raise SmokeError("the read of the test part left no audit entry")
    return {"run_id": run_id, "split_version": S.split_version(split, "ord"), "digest": digest, **metrics}
