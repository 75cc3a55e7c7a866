"""Visually identical text with different characters (problem 2).

Every value is brought to one form in which equal looks are equal strings:

1. characters that show nothing go, every kind of single blank becomes U+0020,
   full-width and presentation forms become the plain characters;
2. marks are put in canonical order, composed in the end (NFC);
3. per token the script sets of its letters are intersected; a letter drawn
   alike in several scripts carries all of them, any other letter its own.  The
   scripts that remain are those in which the whole token can be spelled.  A
   token whose letters exclude each other is mixed-script; one made only of
   look-alikes is a whole-script confusable.  The spelling is chosen from the
   letters that are *not* look-alikes (of the token, else of the text), so two
   values that look the same always get the same spelling.

Case, punctuation, diacritics, raised or lowered digits and the number of
blanks are visible and stay.  The table of look-alikes covers single letters of
the alphabets that borrow or resemble Latin, Greek and Cyrillic shapes (those and
Coptic, Armenian, Cherokee, Lisu, Canadian syllabics); letters that merely
resemble each other in some fonts (alpha and a, chi and x) stay apart.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapidary.functions.text import normalize_py
from lapidary.session import stage

FIELDS = ("text", "hieroglyphs", "transliteration")

# fixed values: letters drawn alike, one class per line; the first letter of a script is the one it is spelled with
ALIKE = """
a а ɑ
b Ꮟ ᑲ
c ϲ с ⲥ ᴄ
d ԁ Ꮷ ᑯ
e е
g ɡ ց
h һ հ
i і Ꭵ
j ϳ ј յ
l ӏ
n ո ռ
o ο о ⲟ օ ᴏ
p ρ р ⲣ
q ԛ զ գ
s ѕ ꜱ
u ս
v ν ѵ ᴠ
w ԝ ᴡ
x х
y у
z ᴢ
χ ⲭ
A Α А Ⲁ Ꭺ ꓮ ᗅ
B Β В Ⲃ Ᏼ ꓐ ᗷ
C Ϲ С Ⲥ Ꮯ ꓚ
D Ꭰ ꓓ ᗞ
E Ε Е Ꭼ ꓰ
F Ϝ ꓝ ᖴ
G Ԍ Ꮐ ꓖ
H Η Н Ⲏ Ꮋ ꓧ ᕼ
I Ι І Ⲓ Ӏ ꓲ
J Ϳ Ј Ꭻ ꓙ ᒍ
K Κ К Ⲕ Ꮶ ꓗ
L Լ Ꮮ ꓡ ᒪ
M Μ М Ⲙ Ꮇ ꓟ ᗰ
N Ν Ⲛ ꓠ
O Ο О Ⲟ Օ ꓳ
P Ρ Р Ⲣ Ꮲ ꓑ ᑭ
Q Ԛ
R Ꭱ Ꮢ ꓣ ᖇ
S Ѕ Տ Ꮪ Ꮥ ꓢ
T Τ Т Ⲧ Ꭲ ꓔ
U Ս ꓴ ᑌ
V Ѵ Ꮩ ꓦ ᐯ
W Ԝ Ꮃ Ꮤ ꓪ
X Χ Х Ⲭ ꓫ
Y Υ Ү Ⲩ Ꮍ ꓬ
Z Ζ Ⲍ Ꮓ ꓜ
Φ Ф Ⲫ
Γ Г Ⲅ
Π П Ⲡ
κ к ⲕ ᴋ
ᴛ т ⲧ
ʙ в ⲃ
ʜ н ⲏ
ᴍ м ⲙ
г ⲅ
ɴ ⲛ
ə ә
Ə Ә
ɜ з
ɵ ө
Ɵ Ө
"""


def _by_script(letters: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for c in letters:
        out.setdefault(unicodedata.name(c).split()[0], c)
    return out


_LINES = [line.split() for line in ALIKE.strip().splitlines()]
CLASSES = [_by_script(x) for x in _LINES]
CLASS_OF = {c: i for i, x in enumerate(_LINES) for c in x}

# fixed values: code points that show nothing (default ignorable), and blocks of full-width and presentation forms
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
FORMS = [(0xFB00, 0xFDFF), (0xFE10, 0xFE1F), (0xFE30, 0xFE4F), (0xFE50, 0xFEFE), (0xFF01, 0xFFEF)]


class _Plain(dict):
    """Per character: gone, a blank, the plain form, or itself."""

    def __missing__(self, cp: int):
        c = chr(cp)
        cat = unicodedata.category(c)
        if any(a <= cp <= b for a, b in IGNORABLE) or (cat == "Cc" and not c.isspace()):
            v = None
        elif cat == "Zs":
            v = " "
        elif any(a <= cp <= b for a, b in FORMS) or unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")):
            v = unicodedata.normalize("NFKC", c)
        else:
            v = cp
        self[cp] = v
        return v


class _Script(dict):
    """Script of a letter that is no look-alike; None for all else."""

    def __missing__(self, c: str):
        v = None
        if c not in CLASS_OF and unicodedata.category(c)[0] == "L":
            v = unicodedata.name(c, "OTHER").split()[0]
        self[c] = v
        return v


_plain, _script = _Plain(), _Script()
_WORD = re.compile(r"\w")


def _spell(token: str, scripts: list[str]) -> str:
    """``token`` with each look-alike in the first of ``scripts`` that has it, else in the first that exists."""
    out = []
    for c in token:
        k = CLASS_OF.get(c)
        if k is None:
            out.append(c)
        else:
            m = CLASSES[k]
            out.append(next((m[s] for s in scripts if s in m), None) or next(iter(m.values())))
    return "".join(out)


def resolve(token: str) -> tuple[str, tuple[str, ...], str | None]:
    """``(kind, own scripts, spelling)`` of a decomposed token.

    kind is ``plain`` (no look-alike), ``single`` (some script fits all letters),
    ``mixed`` (none does) or ``whole`` (look-alikes only: the text decides, no
    spelling yet).
    """
    own = Counter(s for s in map(_script.__getitem__, token) if s)
    alike = [CLASSES[CLASS_OF[c]].keys() for c in token if c in CLASS_OF]
    if not alike:
        return "plain", tuple(own), token
    if not own:
        return "whole", (), None
    left = set(own) if len(own) == 1 else set()
    for s in alike:
        left &= set(s)
    if left:
        return "single", tuple(own), _spell(token, sorted(left))
    return "mixed", tuple(own), _spell(token, sorted(own, key=lambda s: (-own[s], s)))


_tokens: dict[str, tuple] = {}


def _resolved(token: str) -> tuple:
    r = _tokens.get(token)
    if r is None:
        if len(_tokens) > 200_000:
            _tokens.clear()
        r = _tokens[token] = resolve(token)
    return r


def consistent_form(v: str | None) -> str | None:
    """The one form of ``v``; null stays null, text without visible characters becomes empty or blanks."""
    if v is None:
        return None
    if not v.isascii():
        v = unicodedata.normalize("NFD", v.translate(_plain))
    elif not v.isprintable():
        v = v.translate(_plain)
    out = [(t, _resolved(t)) for t in v.split(" ")]
    if any(r[2] is None for _, r in out):
        seen: Counter = Counter()
        for _, r in out:
            seen.update(r[1])
        order = sorted(seen, key=lambda s: (-seen[s], s))
        s = " ".join(_spell(t, order) if r[2] is None else r[2] for t, r in out)
    else:
        s = " ".join(r[2] for _, r in out)
    return s if s.isascii() else unicodedata.normalize("NFC", s)


@F.pandas_udf(T.StringType())
def consistent(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column form of :func:`consistent_form`."""
    for s in parts:
        yield s.map(consistent_form, na_action="ignore")


def consistent_values(records: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(field, ord, value, form, changed)`` of every value that is not null. An empty table gives an empty result."""
    long = records.select("ord", F.explode(F.map_filter("fields", lambda k, v: k.isin(*fields) & v.isNotNull())).alias("field", "value"))
    return long.withColumn("form", consistent("value")).select("field", "ord", "value", "form", (F.col("form") != F.col("value")).alias("changed"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    md5 = lambda s: hashlib.md5(s.encode("utf-8", "surrogatepass")).digest()
    for b in batches:
        seen = [bool(_WORD.search(v)) or normalize_py(v) != "" for v in b.column(2).to_pylist()]
        b = b.filter(pa.array(seen, pa.bool_()))
        vals = b.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([md5(consistent_form(v)) for v in vals], pa.binary()), pa.array([md5(v) for v in vals], pa.binary())],
            names=["field", "ord", "form", "raw"],
        )


def lookalike_pairs(records: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(field, ord_a, ord_b)``: records whose values have the same form but are different strings.

    Only 128-bit digests are shuffled.  Different spellings are paired first, one
    row per spelling, and only then expanded to their records, so copies of one
    spelling are never compared with each other.  Null, absent and empty values
    are no cases, nor are values without any letter or number.  Repeated rows of
    one record add nothing.
    """
    long = records.select("ord", F.explode(F.map_filter("fields", lambda k, v: k.isin(*fields) & (F.coalesce(v, F.lit("")) != ""))).alias("field", "value"))
    rows = long.select("field", "ord", "value").mapInArrow(_digests, "field string, ord long, form binary, raw binary")
    rows = stage(rows, "forms")
    spelled = rows.groupBy("field", "form", "raw").agg(F.lit(1).alias("one")).drop("one")
    many = rows.groupBy("field", "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("field", "form")
    spelled = stage(spelled.join(many, ["field", "form"]), "spellings")
    pairs = spelled.alias("a").join(spelled.alias("b"), (F.expr("a.field = b.field and a.form = b.form and a.raw < b.raw"))).select("a.field", F.col("a.raw").alias("ra"), F.col("b.raw").alias("rb"))
    held = rows.join(spelled, ["field", "form", "raw"], "left_semi").select("field", "raw", "ord")
    a, b = held.select("field", F.col("raw").alias("ra"), F.col("ord").alias("oa")), held.select("field", F.col("raw").alias("rb"), F.col("ord").alias("ob"))
    return (
        pairs.join(a, ["field", "ra"]).join(b, ["field", "rb"]).where("oa <> ob").select("field", F.least("oa", "ob").alias("ord_a"), F.greatest("oa", "ob").alias("ord_b")).distinct()
    )
