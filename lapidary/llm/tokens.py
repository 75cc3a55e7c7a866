"""Token budget per source and language (problem 4).

Counts are exact and no token identifiers are made.  A vocabulary is compiled
into a matching automaton (Aho-Corasick), which gives at every position all
pieces that end there; the count of the encoding of each prefix follows from a
shorter prefix, in time linear in the text.

* ``BpeCounter``: byte-pair vocabularies.  The last token of a prefix is the one
  piece that ends there and is *compatible* with the last token of what is left:
  the two stand side by side in an encoding exactly if encoding their
  concatenation gives them back.  Compatibility is decided by undoing merges and
  kept per pair.
* ``UnigramCounter``: vocabularies with log probabilities, as that of
  ``tokenizer_pieces``.  There are no merges, so pair compatibility is not
  defined; the encoding is the path of the greatest sum, found over the same
  automaton.

Words are counted once per worker and remembered, so a text costs a look-up per
word.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBER = 400_000  # words a worker remembers before it starts anew
UNKNOWN = 10.0  # fixed value: an unknown character scores the least piece score less this
SPACE = "▁"
# fixed value: how the public byte-level vocabularies cut a text into words
BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class UnigramCounter:
    """Exact token counts under a unigram vocabulary with byte pieces."""

    def __init__(self, pieces: list[tuple[int, str, float]]) -> None:
        self.byte = {p for _, p, _ in pieces if len(p) == 6 and p.startswith("<0x") and p.endswith(">")}
        plain = [(p, s) for i, p, s in pieces if i > 3 and p and p not in self.byte]
        self.least = min((s for _, s in plain), default=0.0) - UNKNOWN
        self.single = {p for p, _ in plain if len(p) == 1}
        self.a = ahocorasick.Automaton()
        for p, s in plain:
            self.a.add_word(p, (len(p), s))
        if plain:
            self.a.make_automaton()
        self.empty = not plain
        self.known: dict[str, int] = {}

    def word(self, w: str) -> int:
        """Tokens of one word, with the mark of the blank before it."""
        n = self.known.get(w)
        if n is None:
            if len(self.known) > REMEMBER:
                self.known.clear()
            n = self.known[w] = self._encode(SPACE + w)
        return n

    def _encode(self, t: str) -> int:
        n = len(t)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if not self.empty:
            for end, hit in self.a.iter(t):
                ends[end].append(hit)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for i in range(n):
            top, k = None, 0
            for size, score in sorted(ends[i], reverse=True):  # of equals the longest piece stays
                s = best[i + 1 - size] + score
                if top is None or s > top:
                    top, k = s, count[i + 1 - size] + 1
            if t[i] not in self.single:  # without a piece of its own: unknown, spelled in bytes
                s = best[i] + self.least
                if top is None or s > top:
                    top, k = s, count[i] + (len(t[i].encode("utf-8", "surrogatepass")) if self.byte else 1)
            best[i + 1], count[i + 1] = top, k
        return count[n]

    def count(self, text: str) -> int:
        word = self.word
        return sum(map(word, text.split()))


class BpeCounter:
    """Exact token counts under a byte-level pair vocabulary with ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.rank = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.a = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.a.add_word(b.decode("latin-1"), r)
        self.a.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, int] = {}

    def _split(self, token: int) -> tuple[int, int] | None:
        """The merge that makes a token: the last pair left when its bytes are merged by rank."""
        if token not in self.halves:
            parts = [bytes([x]) for x in self.tokens[token]]
            if len(parts) < 2:
                self.halves[token] = None
            else:
                while len(parts) > 2:
                    r, i = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                    if r >= 1 << 60:
                        break
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                self.halves[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of ``a`` followed by ``b`` gives the tokens a, b."""
        key = (a, b)
        r = self.pairs.get(key)
        if r is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            r = self.pairs[key] = self._compatible(a, b)
        return r

    def _compatible(self, a: int, b: int) -> bool:
        limit = 1 << 60  # merges of this rank or above come later than what was undone
        while True:
            joined = self.rank.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < limit:
                return False  # this merge across the border would come first
            x, y = self._split(a), self._split(b)
            if x is None and y is None:
                return True
            # undo the younger merge of the two
            if y is None or (x is not None and a > b):
                limit, a = a, x[1]
            else:
                limit, b = b + 1, y[0]

    def _encode(self, w: str) -> int:
        raw = w.encode("utf-8", "surrogatepass")
        if raw in self.rank:
            return 1
        t = raw.decode("latin-1")
        n = len(t)
        ends: list[list[int]] = [[] for _ in range(n)]
        for end, r in self.a.iter(t):
            ends[end].append(r)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            for r in ends[i]:
                if len(self.tokens[r]) > 1 and self._split(r) is None:
                    continue  # no sequence of merges makes it
                at = i + 1 - len(self.tokens[r])
                if at == 0 or (last[at] >= 0 and self.compatible(last[at], r)):
                    last[i + 1], count[i + 1] = r, count[at] + 1
                    break
        return count[n]

    def count(self, text: str) -> int:
        known, total = self.known, 0
        for w in self.pattern.findall(text):
            n = known.get(w)
            if n is None:
                if len(known) > REMEMBER:
                    known.clear()
                n = known[w] = self._encode(w)
            total += n
        return total


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def _counted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(…, text) -> (…, tokens)."""
    count = shared.value.count
    for b in batches:
        n = [None if v is None else count(v) for v in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "tokens"])


class _Lazy:
    """Builds the counter in the worker, once: an automaton is not shipped."""

    def __init__(self, make, *args) -> None:
        self.make, self.args, self.made = make, args, None

    def __reduce__(self):
        return _Lazy, (self.make, *self.args)

    def count(self, text: str) -> int:
        if self.made is None:
            self.made = self.make(*self.args)
            self.count = self.made.count  # type: ignore[method-assign]
        return self.made.count(text)


def with_tokens(df: DataFrame, text: str, counter: "_Lazy") -> DataFrame:
    """``df`` without the column ``text``, with ``tokens``; null text gives null, empty text 0."""
    from pyspark.sql import types as T

    shared = df.sparkSession.sparkContext.broadcast(counter)
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("tokens", T.LongType())])
    return df.select(*keep, text).mapInArrow(lambda it: _counted(it, shared), schema)


def unigram_counter(pieces: DataFrame) -> _Lazy:
    """Counter of a vocabulary table, built in each worker; a vocabulary is bounded and goes through the driver."""
    rows = pieces.where("piece is not null").select("piece_id", "piece", F.coalesce("score", F.lit(0.0))).collect()
    return _Lazy(UnigramCounter, [tuple(r) for r in rows])


def bpe_counter(path: str, pattern: str) -> _Lazy:
    """Counter of a vocabulary file of ranks, read once on the driver."""
    return _Lazy(BpeCounter, read_ranks(path), pattern)


def all_texts(records: DataFrame, documents: DataFrame, corpora: DataFrame) -> DataFrame:
    """``(origin, id, field, slice, lang, domain, text)`` of the texts to be counted.

    Records: ``text`` and ``translation_de``, slice = corpus, language and domain
    of the field from ``corpora``.  Documents: slice = source; language in lower
    case, null if undetermined.  Null values are no texts; an absent slice,
    language or domain stays null.
    """
    c = F.broadcast(corpora.select("corpus", "primary_field", "primary_lang", "translation_field", "translation_lang", "domain"))  # a row per corpus
    r = records.select("ord", "corpus", F.explode(F.map_filter("fields", lambda k, v: k.isin("text", "translation_de") & v.isNotNull())).alias("field", "text")).join(c, "corpus", "left")
    lang = F.when(F.col("field") == F.col("primary_field"), F.col("primary_lang")).when(F.col("field") == F.col("translation_field"), F.col("translation_lang"))
    r = r.select(F.lit("records").alias("origin"), F.col("ord").alias("id"), "field", F.col("corpus").alias("slice"), lang.alias("lang"), "domain", "text")
    low = F.lower(F.trim("lang"))
    known = F.when(~low.isin("", "und", "unknown", "xx", "mul", "zxx"), low)
    d = documents.where("text is not null").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.lit("text").alias("field"), F.col("source").alias("slice"), known.alias("lang"), "domain", "text"
    )
    return r.unionByName(d)


def token_cube(counted: DataFrame) -> DataFrame:
    """Texts and tokens per origin and every combination of slice, language and domain; ``grouping`` tells a total from a null."""
    per = counted.groupBy("origin", "slice", "lang", "domain").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    g = F.grouping("slice") * 4 + F.grouping("lang") * 2 + F.grouping("domain")
    out = per.cube("origin", "slice", "lang", "domain").agg(F.sum("n").alias("n_texts"), F.sum("t").alias("n_tokens"), g.cast("int").alias("grouping"), F.grouping("origin").alias("go"))
    return out.where("go = 0").drop("go")
