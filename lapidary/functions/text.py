"""Text normalisation and token functions.

Spark has no NFKC, so ``normalize_target`` runs as an Arrow UDF over a cached
per-character table; everything else is a built-in expression.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Keep(dict):
    """Translation table: letters, numbers and ``_`` stay, white space becomes a blank, the rest goes."""

    def __missing__(self, cp: int):
        c = chr(cp)
        if c.isspace():
            v = " "
        elif c == "_" or unicodedata.category(c)[0] in "LN":
            v = cp
        else:
            v = None
        self[cp] = v
        return v


_keep = _Keep()


def normalize_py(v: str | None) -> str | None:
    """NFKC, lower case, delete what is neither letter, number, ``_`` nor white space, collapse blanks, trim."""
    if v is None:
        return None
    if not v.isascii():
        v = unicodedata.normalize("NFKC", v)
    return " ".join(v.lower().translate(_keep).split())


@F.pandas_udf(T.StringType())
def normalize_target(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column form of :func:`normalize_py`; null stays null."""
    for s in parts:
        yield s.map(normalize_py, na_action="ignore")


def words(col: Column | str) -> Column:
    """Parts between Unicode white space; null gives null, blank text gives an empty array."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(c, r"(?U)[\s\x{1c}-\x{1f}]+"), lambda t: t != "")


def token_count(col: Column | str) -> Column:
    """Number of white-space tokens; null counts 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), 0).otherwise(F.size(words(c)))


def extract_signs(col: Column | str) -> Column:
    """Distinct signs of a text: characters U+13000 to U+1345F, then the contents of ``<g>…</g>``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit(r"[\x{13000}-\x{1345F}]"), 0), F.regexp_extract_all(c, F.lit("<g>([^<]+)</g>"), 1)))


def prepare_text(col: Column | str) -> Column:
    """``<g>…</g>`` becomes a box, blanks are collapsed and trimmed. An empty ``<g></g>`` is a box too."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<g>[^<]*</g>", "▯"), r"(?U)[\s\x{1c}-\x{1f}]+", " "))


def period_bucket(col: Column | str) -> Column:
    """Century of a year string, floored (``c-16`` for -1580); anything else is ``unknown``."""
    c = F.col(col) if isinstance(col, str) else col
    year = F.regexp_extract(F.trim(c), r"^[+-]?\d{1,9}$", 0).try_cast("int")
    return F.when(year.isNotNull(), F.format_string("c%+d", F.floor(year / 100).cast("int"))).otherwise("unknown")


def encipher(col: Column | str, key: dict[str, str]) -> Column:
    """Characters replaced by ``key``; others pass through."""
    c = F.col(col) if isinstance(col, str) else col
    one = {a: b for a, b in key.items() if len(b) == 1}
    if len(one) == len(key):
        return F.translate(c, "".join(one), "".join(one.values()))
    m = F.create_map(*[x for a, b in key.items() for x in (F.lit(a), F.lit(b))])
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.coalesce(F.try_element_at(m, x), x)), "")


def filled(fields: str, key: str) -> Column:
    """The key is present and its value is not blank."""
    return F.map_contains_key(fields, key) & (F.size(words(F.col(fields)[key])) > 0)


def parallel_pair(fields: str, source: str, target: str) -> Column:
    """Both keys are present; blank values count (unlike :func:`filled`)."""
    return F.map_contains_key(fields, source) & F.map_contains_key(fields, target)


def font_of(corpus: Column | str) -> Column:
    """Font family of a corpus: by prefix, else by the first of four names it contains, else the default."""
    c = F.col(corpus) if isinstance(corpus, str) else corpus
    out = F.when(c.startswith("tla"), "egyptian")
    for name in ("coptic", "hebrew", "greek", "cuneiform"):
        out = out.when(c.contains(name), name)
    return out.otherwise("default")


def is_test_path(col: Column | str, root: str | None = None) -> Column:
    """A path inside the data root (or behind its first ``data`` component) with a ``test`` folder, or whose name starts with ``test.``."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.split(c, "/")
    if root:
        inside, below = c.startswith(root.rstrip("/") + "/"), F.split(F.substr(c, F.lit(len(root.rstrip("/")) + 2)), "/")
    else:
        at = F.array_position(parts, "data").cast("int")
        inside, below = at > 0, F.slice(parts, at + 1, F.size(parts))
    folder = F.array_contains(F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0))), "test")
    return F.coalesce(inside & (folder | F.try_element_at(below, F.lit(-1)).startswith("test.")), F.lit(False))


def run_timestamp(col: Column | str) -> Column:
    """Start of a run from its id ``YYYYMMDD-HHMMSS-…``; null if it does not look so."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(F.regexp_extract(c, r"^\d{8}-\d{6}", 0), F.lit("yyyyMMdd-HHmmss"))


def nats_to_bits(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c / F.ln(F.lit(2.0))
