"""The normal form of texts in DuckDB's SQL, which has no compatibility normalisation of its own.

Tables of characters are built by rule from the Unicode data of the interpreter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

# fixed values: Unicode white space
BLANK = r"\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def char_table(name: str, of: Callable[[str], str]) -> str:
    """CTE ``name(c, r)`` of the characters that ``of`` changes beyond canonical equivalence."""
    nfc = lambda t: unicodedata.normalize("NFC", t)
    rows = []
    for cp in range(1, 0x110000):
        c = chr(cp)
        if not 0xD800 <= cp <= 0xDFFF and unicodedata.category(c) not in ("Cn", "Co") and nfc(r := of(c)) != nfc(c):
            rows.append((c, r))
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return f"{name} AS (SELECT unnest([{', '.join(f'chr({ord(c)})' for c, _ in rows)}]) AS c, unnest([{', '.join(quoted(r) for _, r in rows)}]) AS r)"


@cache
def compatible() -> str:
    return char_table("_compat", lambda c: unicodedata.normalize("NFKD", c))


def mapped(name: str, source: str, key: str, table: str) -> str:
    """CTE ``name(key, v)``: ``v`` of ``source(key, v)`` with the characters of ``table`` replaced, composed."""
    return f"""
      {name}_c AS (SELECT {key}, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM (SELECT {key}, regexp_extract_all(v, '(?s).') AS x FROM {source})),
      {name} AS (SELECT {key}, nfc_normalize(string_agg(coalesce(r, c), '' ORDER BY i)) AS v FROM {name}_c LEFT JOIN {table} USING (c) GROUP BY ALL)"""


def normal(x: str) -> str:
    """Lower case, letters, numbers, ``_`` and single blanks only, of an expression that is compatibility-normalised; the last sigma of a word is final."""
    sigma = rf"regexp_replace({x}, '(\p{{L}}\p{{M}}*)Σ(\p{{M}}*)($|[^\p{{L}}\p{{M}}])', '\1ς\2\3', 'g')"
    kept = rf"regexp_replace(lower({sigma}), '[^\p{{L}}\p{{N}}_{BLANK}]', '', 'g')"
    return f"trim(regexp_replace({kept}, '[{BLANK}]+', ' ', 'g'))"


def normed(name: str, source: str, key: str) -> str:
    """CTEs up to ``name(key, n)``, the normal form of ``v`` of ``source(key, v)``; values without characters do not come out."""
    return f"{compatible()}, {mapped('_' + name, source, key, '_compat')}, {name} AS (SELECT {key}, {normal('v')} AS n FROM _{name})"


def bytewise(name: str, source: str, group: str) -> str:
    """CTE ``name(group, from, to)``: every character of ``n`` within a group gets one byte, since edit distances count bytes here."""
    return f"""
      {name} AS (SELECT {group}, string_agg(c, '' ORDER BY c) AS f, string_agg(chr(32 + k::INT), '' ORDER BY c) AS t FROM (
        SELECT {group}, c, row_number() OVER (PARTITION BY {group} ORDER BY c) AS k FROM (SELECT DISTINCT {group}, unnest(regexp_extract_all(n, '(?s).')) AS c FROM {source})) GROUP BY ALL)"""
