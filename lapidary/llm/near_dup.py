"""Near-duplicate records with small edits (problem 5).

A value is the set of its words; two values belong together if the sets share at
least ``threshold`` of their union.  Every word is a *positional byte*: 24 bits of
its hash name a position, 8 bits the byte that stands there, so a value is a
sparse byte string and an inverted index over (position, byte) lists the values
that hold a byte.

Count filtering: sets of a and b words that are similar share at least
``ceil(t / (1 + t) * (a + b))`` words, hence at least that many positional bytes,
less the words of one value that fell on one position.  Bytes are ordered by how
many values hold them (a fixed-size table of counts; any order is correct, a good
one is fast).  Of two values that share s bytes or more, the s-2 most frequent
may be left out: at least two shared bytes stand in the prefixes, so the index is
probed by *pairs* of prefix bytes.  Every entry carries a signature, the parity of
the words on each of 64 bits; pairs whose signatures differ in more bits than
similar sets differ in words are dropped where they are met, so few are listed but
the similar ones, however many values share a key.  Those left are tallied over all
their bytes, those that reach the guaranteed minimum are verified on 64-bit word fingerprints.

A pair of bytes that more than ``crowd`` values hold (a stock phrase) is not
paired: its values go on with a third byte, of the longer prefix in which three
shared bytes stand, and so on up to ``LEVELS``.  Values that still share all of
these are compared in blocks of ``crowd``, block against block, so no task holds
more than two blocks, whatever stands under one key.

Equal sets form one class; only classes are indexed and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.functions.text import normalize_py
from lapidary.session import release, stage

FIELDS = ("translation_de", "transliteration")
COUNTS = 1 << 20  # cells of the table that orders the bytes; fixed, whatever the data
LEVELS = 5  # bytes of a key at most
_hash: dict[str, int] = {}


def _word(w: str) -> int:
    h = _hash.get(w)
    if h is None:
        if len(_hash) > 500_000:
            _hash.clear()
        h = _hash[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) - (1 << 63)
    return h


def _sets(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(field, ord, value) -> (field, ord, class digest, sorted 64-bit fingerprints of the distinct words)."""
    for b in batches:
        f, o, c, ws = [], [], [], []
        for field, ord_, v in zip(*(x.to_pylist() for x in b.columns)):
            t = normalize_py(v).split()
            if len(t) < max(least, 1):
                continue
            s = sorted(set(t))
            f.append(field)
            o.append(ord_)
            c.append(hashlib.md5("\x1f".join([field, *s]).encode("utf-8", "surrogatepass")).digest())
            ws.append(np.sort(np.fromiter(map(_word, s), np.int64, len(s))))
        off = np.zeros(len(ws) + 1, np.int32)
        off[1:] = np.cumsum([len(x) for x in ws])
        flat = np.concatenate(ws) if ws else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(f, pa.string()), pa.array(o, pa.int64()), pa.array(c, pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["field", "ord", "class", "words"]
        )


def _prefix(order: np.ndarray, n: int, t: Fraction, level: int) -> tuple[np.ndarray, int]:
    """Bytes among which any similar value shares ``level``, and the guaranteed number of shared bytes.

    ``order`` holds the n words' bytes with their frequency in the high half.
    Words on one position and byte fall together; the guarantee drops by them.
    """
    p = np.unique(order)
    least = -((-t.numerator * n) // t.denominator) - (n - len(p))
    return np.sort(p[: max(len(p) - max(least, level) + level, 1)] & 0xFFFFFFFF), least


def _order(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    byte = (words.view(np.uint64) >> np.uint64(32)).astype(np.int64)  # 24 bits of position, 8 of byte
    return (counts[byte & (COUNTS - 1)] << 32) | byte


def _signature(words: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64 bits a value, each the parity of the words on it: one word more or less changes one bit."""
    bit = np.uint64(1) << (words.view(np.uint64) & np.uint64(63))
    out = np.zeros(len(off) - 1, np.uint64)
    some = np.flatnonzero(off[1:] > off[:-1])
    if len(some):
        out[some] = np.bitwise_xor.reduceat(bit, off[some])
    return out.view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch], counts: np.ndarray, t: Fraction) -> Iterator[pa.RecordBatch]:
    """(rep, words) -> (key, rep, n, sig): pairs of prefix bytes; values with a guarantee below two also give single bytes."""
    for b in batches:
        keys, reps, sizes, sigs = [], [], [], []
        rep, col = b.column(0).to_numpy(), b.column(1)
        off, words = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
        order, sig = _order(words, counts), _signature(words, off)
        for i in range(len(rep)):
            own = order[off[i] : off[i + 1]]
            p, least = _prefix(own, len(own), t, 2)
            x, y = np.triu_indices(len(p), 1)
            k = (p[x] << 32) | p[y]
            if least < 2:
                k = np.concatenate([k, (p << 32) | p])
            keys.append(k)
            reps.append(np.full(len(k), rep[i]))
            sizes.append(np.full(len(k), len(own), np.int32))
            sigs.append(np.full(len(k), sig[i]))
        z = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, reps, sizes, sigs)]
        yield pa.RecordBatch.from_arrays([pa.array(z[0].astype(np.int64)), pa.array(z[1].astype(np.int64)), pa.array(z[2].astype(np.int32)), pa.array(z[3].astype(np.int64))], names=["key", "rep", "n", "sig"])


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


def _extended(batches: Iterator[pa.RecordBatch], counts: np.ndarray, t: Fraction, level: int) -> Iterator[pa.RecordBatch]:
    """(key, rep, n, used, words) of crowded keys -> keys of ``level`` bytes: one more shared byte stands in the longer prefix.

    A key is the sum of its mixed bytes, whatever their order.  Values whose
    guarantee is below ``level`` bytes stay under their key as well.
    """
    for b in batches:
        keys, reps, sizes, sigs, use = [], [], [], [], []
        key, rep, size, used, col = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist(), b.column(4)
        off, words = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
        order, sig = _order(words, counts), _signature(words, off)
        for i in range(len(rep)):
            own = order[off[i] : off[i + 1]]
            p, least = _prefix(own, len(own), t, level)
            u = np.array(used[i], np.int64)
            z = p[~np.isin(p, u)]
            k = (_mixed(z) + _mixed(u).sum(dtype=np.uint64)).view(np.int64)
            use += [[*used[i], x] for x in z.tolist()]
            if least < level:
                k = np.append(k, key[i])
                use.append(used[i])
            keys.append(k)
            reps.append(np.full(len(k), rep[i]))
            sizes.append(np.full(len(k), size[i], np.int32))
            sigs.append(np.full(len(k), sig[i]))
        z = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, reps, sizes, sigs)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(z[0].astype(np.int64)), pa.array(z[1].astype(np.int64)), pa.array(z[2].astype(np.int32)), pa.array(z[3].astype(np.int64)), pa.array(use, pa.list_(pa.int64()))],
            names=["key", "rep", "n", "sig", "used"],
        )


def _tally(batches: Iterator[pa.RecordBatch], t: Fraction, fields: int, crowd: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, rep, n, sig) sorted by key -> pairs (a, b) of one key and field whose sizes and signatures can be similar; rows of crowded keys come out as (rep, -1, key, n).

    Similar sets of a and b words differ in at most a + b - 2 s words, s being
    what they share at least, and their signatures in no more bits.
    """

    def pairs(k: np.ndarray, r: np.ndarray, n: np.ndarray, sig: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        d, at = 1, np.arange(len(k))
        while True:
            at = at[at + d < len(k)]
            at = at[k[at] == k[at + d]]
            if not len(at):
                return
            x, y = r[at], r[at + d]
            lo, hi = np.minimum(n[at], n[at + d]).astype(np.int64), np.maximum(n[at], n[at + d]).astype(np.int64)
            ok = (x != y) & ((x - y) % fields == 0) & (lo * t.denominator >= hi * t.numerator)
            if sig is not None:
                most = (lo + hi) + 2 * (-(lo + hi) * t.numerator // (t.numerator + t.denominator))
                ok &= np.bitwise_count((sig[at] ^ sig[at + d]).view(np.uint64)) <= most
            if ok.any():
                x, y = x[ok], y[ok]
                yield out(np.minimum(x, y), np.maximum(x, y), np.zeros(len(x), np.int64), np.zeros(len(x), np.int32))
            d += 1

    def out(a, b, k, n):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(k), pa.array(n.astype(np.int32))], names=["a", "b", "key", "n"])

    def run(k: np.ndarray, r: np.ndarray, n: np.ndarray, *sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        if crowd:
            _, inv, many = np.unique(k, return_inverse=True, return_counts=True)
            hot = many[inv] > crowd
            if hot.any():
                yield out(r[hot], np.full(hot.sum(), -1, np.int64), k[hot], n[hot])
                k, r, n, *sig = (x[~hot] for x in (k, r, n, *sig))
        yield from pairs(k, r, n, *sig)

    def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*parts)] if len(parts) > 1 else parts[0]

    held: list[list[np.ndarray]] = []  # rows of the last key, which may go on in the next batch
    crowded = None  # a key that has passed the limit: its further rows go straight on
    for b in batches:
        cur = [c.to_numpy() for c in b.columns]
        if not len(cur[0]):
            continue
        if crowded is not None:
            n = int(np.searchsorted(cur[0], crowded, side="right"))
            if n:
                yield out(cur[1][:n], np.full(n, -1, np.int64), cur[0][:n], cur[2][:n])
            cur = [x[n:] for x in cur]
            if not len(cur[0]):
                continue
            crowded = None
        if held and held[0][0][0] == cur[0][-1]:
            held.append(cur)
        else:
            cur = joined([*held, cur])
            last = int(np.searchsorted(cur[0], cur[0][-1]))
            yield from run(*[x[:last] for x in cur])
            held = [[x[last:] for x in cur]]
        if crowd and sum(len(x[0]) for x in held) > crowd:
            k, r, n = joined(held)[:3]
            yield out(r, np.full(len(r), -1, np.int64), k, n)
            crowded, held = k[0], []
    if held:
        yield from run(*joined(held))


def classes(records: DataFrame, fields: tuple[str, ...] = FIELDS, least_words: int = 8) -> tuple[DataFrame, DataFrame]:
    """``(membership(field, ord, rep), classes(rep, words))``: records with equal word sets, ``rep`` = least ord x fields + field number.

    Values with fewer than ``least_words`` words (repeats counted), null, absent
    and empty values are in no class.
    """
    long = records.select("ord", F.explode(F.map_filter("fields", lambda k, v: k.isin(*fields) & (F.coalesce(v, F.lit("")) != ""))).alias("field", "value"))
    rows = stage(long.select("field", "ord", "value").mapInArrow(lambda it: _sets(it, least_words), "field string, ord long, class binary, words array<long>"), "sets")
    number = F.array_position(F.array(*[F.lit(f) for f in fields]), F.first("field")) - 1
    cl = stage(rows.groupBy("class").agg((F.min("ord") * len(fields) + number).alias("rep"), F.first("words").alias("words")), "classes")
    return rows.select("field", "ord", "class").join(cl.select("class", "rep"), "class").select("field", "ord", "rep").distinct(), cl.select("rep", "words")


def _reaches(t: Fraction) -> Column:
    """The tally: the positional bytes that ``wa`` and ``wb`` share, and those that fell together in one of them, reach the guaranteed minimum."""
    a, b = (F.transform(w, lambda x: F.shiftrightunsigned(x, 32)) for w in ("wa", "wb"))
    fell = F.least(F.size("wa") - F.size(F.array_distinct(a)), F.size("wb") - F.size(F.array_distinct(b)))
    return (F.size(F.array_intersect(a, b)) + fell) * (t.numerator + t.denominator) >= (F.size("wa") + F.size("wb")) * t.numerator


def similar_classes(cl: DataFrame, threshold: str = "0.7", fields: int = len(FIELDS), crowd: int = 256) -> DataFrame:
    """``(a, b)``, a < b: pairs of classes whose word sets share at least ``threshold`` of their union."""
    t = Fraction(threshold)
    spark = cl.sparkSession
    cell = F.shiftrightunsigned("w", 32).bitwiseAND(F.lit(COUNTS - 1))
    seen = cl.select(F.explode("words").alias("w")).groupBy(cell.cast("int").alias("c")).agg(F.count("*").alias("n")).toPandas()  # at most COUNTS rows
    counts = np.zeros(COUNTS, np.int64)
    counts[seen["c"].to_numpy(dtype=np.int64)] = np.minimum(seen["n"].to_numpy(dtype=np.int64), (1 << 30) - 1)
    shared = spark.sparkContext.broadcast(counts.astype(np.int32))

    def pairs_of(keys: DataFrame, limit: int | None) -> DataFrame:
        rows = keys.repartition("key").sortWithinPartitions("key")
        return rows.mapInArrow(lambda it: _tally(it, t, fields, limit), "a long, b long, key long, n int")

    keys = cl.select("rep", "words").mapInArrow(lambda it: _keys(it, shared.value.astype(np.int64), t), "key long, rep long, n int, sig long")
    found = stage(pairs_of(keys, crowd), "tally")
    cand = found.where("b <> -1").select("a", "b")
    byte = lambda shift: F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(0xFFFFFFFF))
    hot = found.where("b = -1").select("key", F.col("a").alias("rep"), "n", F.array(byte(32), byte(0)).alias("used"))
    form = "key long, rep long, n int, sig long, used array<long>"
    for level in range(3, LEVELS + 1):
        if hot.isEmpty():
            break
        longer = stage(hot.join(cl, "rep").select("key", "rep", "n", "used", "words").mapInArrow(lambda it, level=level: _extended(it, shared.value.astype(np.int64), t, level), form), "longer")
        found = stage(pairs_of(longer.select("key", "rep", "n", "sig"), crowd), "tally")
        cand = cand.unionByName(found.where("b <> -1").select("a", "b"))
        rows = found.where("b = -1").select("key", F.col("a").alias("rep"), "n").distinct()
        used = longer.join(rows.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("used").alias("used"))
        hot = stage(rows.join(used, "key"), "crowded")
        release(longer)
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / crowd).cast("int").alias("blocks"))
    own, other = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sig = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))))
    hot = hot.join(blocks, "key").join(cl.select("rep", sig.alias("sig")), "rep").select("key", "rep", "n", "sig", own.alias("own"), other.alias("other"))
    units = hot.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "rep", "n", "sig")
    cand = cand.unionByName(pairs_of(units, None).select("a", "b")).distinct()
    both = cand.join(cl.select(F.col("rep").alias("a"), F.col("words").alias("wa")), "a").join(cl.select(F.col("rep").alias("b"), F.col("words").alias("wb")), "b")
    common, total = F.size(F.array_intersect("wa", "wb")), F.size("wa") + F.size("wb")
    return both.where(_reaches(t)).where(common * (t.numerator + t.denominator) >= total * t.numerator).select("a", "b")


def similar_records(records: DataFrame, fields: tuple[str, ...] = FIELDS, threshold: str = "0.7", least_words: int = 8) -> DataFrame:
    """``(field, ord_a, ord_b)``, ord_a < ord_b: every pair of records with similar values, equal ones included.

    Similar classes are expanded to their records in the end.  Ties, repeated
    rows and records with both fields are handled per field; an empty table
    gives an empty result.
    """
    member, cl = classes(records, fields, least_words)
    member = stage(member, "member")
    links = similar_classes(cl, threshold, len(fields))
    crowded = member.groupBy("rep").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    x, y = member.select("field", F.col("rep").alias("a"), F.col("ord").alias("oa")), member.select(F.col("rep").alias("b"), F.col("ord").alias("ob"))
    out = links.unionByName(crowded).join(x, "a").join(y, "b").where("a <> b or oa < ob")
    return out.select("field", F.least("oa", "ob").alias("ord_a"), F.greatest("oa", "ob").alias("ord_b"))


def near_duplicate_groups(records: DataFrame, fields: tuple[str, ...] = FIELDS, threshold: str = "0.7", least_words: int = 8) -> DataFrame:
    """``(field, ord, group_ord, n_links)``: one row per record that has a partner, with its group (transitive) and the number of similar classes."""
    from lapidary.llm.components import connected_components

    member, cl = classes(records, fields, least_words)
    member = stage(member, "member")
    links = stage(similar_classes(cl, threshold, len(fields)), "links")
    deg = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    cc = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("rep"), "label")
    many = member.groupBy("rep").agg(F.count("*").alias("n"))
    g = member.join(many, "rep").join(deg, "rep", "left").join(cc, "rep", "left").where("n > 1 or n_links > 0")
    label = F.coalesce("label", "rep")
    return g.select("field", "ord", F.floor(label / len(fields)).cast("long").alias("group_ord"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
