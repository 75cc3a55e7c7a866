"""Content identity: canonical JSON, table digests, derived seeds."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(value: object) -> str:
    """JSON with sorted keys, no blanks, non-ASCII kept, unknown types as text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def config_hash(value: object, length: int = 12) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:length]


def derive_seed(base: int, *labels: object) -> int:
    """Seed below 2**31 - 1 from the first four bytes of a digest of base and labels."""
    text = "|".join(str(x) for x in (base, *labels))
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big") % (2**31 - 1)


def order_key(seed: int, label: str, *cols: Column) -> Column:
    """Seeded order that any engine can repeat: the digest of seed, label and key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(label), *[c.cast("string") for c in cols]), 256)


def row_digest(*cols: str) -> Column:
    """Digest of a row, null-safe: maps as sorted entries, every value with its length."""

    def text(c: str) -> Column:
        return F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("null"))

    return F.sha2(F.concat_ws("\x1f", *[text(c) for c in cols]), 256)


def multiset_sums(digest: Column) -> list[Column]:
    """Aggregates that identify a bag of 256-bit digests in any order: its size and the sums of four 64-bit parts, combined map-side."""
    parts = [F.sum(F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return [F.count("*").cast("string").alias("n"), *[F.coalesce(x.cast("string"), F.lit("0")).alias(f"s{i}") for i, x in enumerate(parts)]]


def content_hash(df: DataFrame) -> str:
    """Digest of the rows of a table as a bag, whatever their order, files and partitions."""
    cols = [F.sort_array(F.map_entries(c)).alias(c) if t.startswith("map<") else F.col(c) for c, t in df.dtypes]
    names = sorted(df.columns)
    row = df.select(*cols).agg(*multiset_sums(row_digest(*names))).first()
    return hashlib.sha256("|".join([*names, *row]).encode()).hexdigest()
