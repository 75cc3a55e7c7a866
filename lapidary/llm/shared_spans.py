"""Long exact spans shared between records (problem 10).

Two documents that share a stretch of ``SPAN`` = 300 code points share a chosen
*window* inside it: of every 101 consecutive windows of 200 code points (which
together cover 300) the one with the least hash is chosen, by content alone, so
both documents choose the same.  About one window in fifty is chosen.

One scan of the texts writes the hashes of the chosen windows.  Pass one adds
them to count-min sketches, one a partition, whose cells count none, one, or two
and more; the sketches are merged with bit operations.  There are four cells to a
window, up to ``CELLS``.  The sketch never underestimates, so the windows it
counts once are dropped and none that is repeated is lost.  Pass two counts what
is left exactly, by hash; only windows that stand in two different texts go back
to their texts, which move once, and each pair is verified on the text around the
window: 101 code points before it and 100 behind suffice to tell whether the
common stretch reaches 300 and whether this is its first window, so a stretch
comes out once.

Windows that stand in many places (a header in a third of all rows; an exact
count, never the estimate) are not paired: each is replaced by the spans of 300
that contain it, and only documents with the same span meet, at the first span of
what they have in common.  Identical documents are compared once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapidary.session import stage

SPAN, WINDOW = 300, 200
STEP = SPAN - WINDOW + 1  # windows of a span
CELLS = 1 << 26  # most cells of each of the two rows of the sketch: 16 MB of bits are broadcast at most
CHUNK = 1 << 16  # cells of a sketch that travel in one row
CROWD = 32  # places of a window that is not paired directly
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        m = 1 << int(n).bit_length()
        for i, b in enumerate((int(_BASE), _inverse(int(_BASE)))):
            p = np.full(m, np.uint64(b))
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` code points; equal windows have equal hashes."""
    n = len(codes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _power(n)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=p[1:])
    return _mix((p[width:] - p[:-width]) * down[: n - width + 1])


def _running(h: np.ndarray, step: int, op: np.ufunc, empty: np.uint64) -> np.ndarray:
    """Minimum or maximum of every ``step`` consecutive values, from block-wise running values of both sides."""
    n = len(h)
    v = np.full(-(-n // step) * step, empty)
    v[:n] = h
    grid = v.reshape(-1, step)
    left = op.accumulate(grid, axis=1).ravel()
    right = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - step + 1], left[step - 1 : n])


def chosen(h: np.ndarray, step: int = STEP) -> np.ndarray:
    """Places whose hash is the least of some ``step`` consecutive ones (all of equals)."""
    n = len(h)
    if n < step:
        return np.zeros(0, np.int64)
    low = np.zeros(n + step - 1, np.uint64)
    low[step - 1 : n] = _running(h, step, np.minimum, _NONE)
    # no minimum around a place exceeds its hash; it is chosen if the largest of them equals it
    return np.flatnonzero(_running(low, step, np.maximum, np.uint64(0)) == h)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the chosen windows of a text."""
    h = rolling(_codes(text), WINDOW)
    at = chosen(h)
    return at, h[at]


def _cells(h: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(cells - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, digest of the text, hashes and places of its chosen windows)."""
    for b in batches:
        texts = b.column(1).to_pylist()
        found = [windows(t) for t in texts]
        off = pa.array(np.cumsum([0, *(len(at) for at, _ in found)]), pa.int32())
        keys = np.concatenate([h for _, h in found]).view(np.int64) if found else np.zeros(0, np.int64)
        ats = np.concatenate([at for at, _ in found]).astype(np.int32) if found else np.zeros(0, np.int32)
        digest = pa.array([hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), digest, pa.ListArray.from_arrays(off, pa.array(keys)), pa.ListArray.from_arrays(off, pa.array(ats))], names=["doc_id", "digest", "keys", "ats"])


def _sketch(batches: Iterator[pa.RecordBatch], cells: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """(keys) -> the partition's sketch in chunks of two planes of bits: cells with one window or more, with two or more."""
    table, any_ = np.zeros((2, cells), np.uint8), False
    for b in batches:
        h = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        any_ |= len(h) > 0
        for row, cell in zip(table, _cells(h, cells)):
            cell, n = np.unique(cell, return_counts=True)
            row[cell] = np.minimum(row[cell] + np.minimum(n, 2), 2).astype(np.uint8)
    if any_:
        flat = table.reshape(-1, chunk)
        for i in np.flatnonzero(flat.any(axis=1)):
            yield _chunk(int(i), np.packbits(flat[i] > 0), np.packbits(flat[i] > 1))


def _chunk(i: int, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([one.tobytes()], pa.binary()), pa.array([two.tobytes()], pa.binary())], names=["chunk", "one", "two"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by number -> their sums: two or more where either has, or where both have one."""
    at, one, two = None, None, None
    for b in batches:
        for chunk, x, y in zip(*(c.to_pylist() for c in b.columns)):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            if chunk != at:
                if at is not None:
                    yield _chunk(at, one, two)
                at, one, two = chunk, x, y
            else:
                one, two = one | x, two | y | (one & x)
    if at is not None:
        yield _chunk(at, one, two)


_HASHED = "doc_id long, digest binary, keys array<long>, ats array<int>"


def _open(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Hashed windows -> those the sketch estimates twice or more; texts without any go."""
    bits = np.frombuffer(shared.value, np.uint8).reshape(2, -1)
    cells = bits.shape[1] * 8
    for b in batches:
        keys, ats = b.column(2), b.column(3)
        h = keys.flatten().to_numpy(zero_copy_only=False)
        ok = np.ones(len(h), bool)
        for row, cell in zip(bits, _cells(h.view(np.uint64), cells)):
            ok &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        size = np.diff(keys.offsets.to_numpy())
        left = np.bincount(np.repeat(np.arange(len(size)), size)[ok], minlength=len(size))
        off = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32())
        new = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (h[ok], ats.flatten().to_numpy(zero_copy_only=False)[ok])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *new], names=["doc_id", "digest", "keys", "ats"]).filter(pa.array(left > 0))


_ROWS = "key long, doc_id long, at int, place int, near string, crowded boolean"


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, [(at, key, crowded)]) -> windows with the text around them; for crowded ones the spans that contain them.

    ``place`` is the window's place in ``near``; of a span it is the code point
    before it if the span there comes out too, else -1.
    """
    for b in batches:
        keys, docs, ats, places, near, crowded = [], [], [], [], [], []
        for doc, text, found in zip(*(c.to_pylist() for c in b.columns)):
            wide: set[int] = set()
            for w in found:
                p = w["at"]
                if w["crowded"]:
                    wide.update(range(max(0, p - STEP + 1), min(p, len(text) - SPAN) + 1))
                    continue
                lo = max(0, p - STEP)
                keys.append(w["key"])
                docs.append(doc)
                ats.append(p)
                places.append(p - lo)
                near.append(text[lo : p + WINDOW + STEP - 1])
                crowded.append(False)
            if wide:
                span = rolling(_codes(text), SPAN).view(np.int64)
                for q in sorted(wide):
                    keys.append(span[q])
                    docs.append(doc)
                    ats.append(q)
                    places.append(ord(text[q - 1]) if q - 1 in wide else -1)
                    near.append(hashlib.md5(text[q : q + SPAN].encode("utf-8", "surrogatepass")).hexdigest())
                    crowded.append(True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(ats, pa.int32()), pa.array(places, pa.int32()), pa.array(near, pa.string()), pa.array(crowded, pa.bool_())],
            names=["key", "doc_id", "at", "place", "near", "crowded"],
        )


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def extent(x: str, px: int, y: str, py: int) -> tuple[int, int] | None:
    """How far the common stretch reaches to both sides of the windows at px, py, as far as the texts go; None if it stays below SPAN."""
    if x[px : px + WINDOW] != y[py : py + WINDOW]:
        return None
    left, right = _common(x[:px][::-1], y[:py][::-1]), _common(x[px + WINDOW :], y[py + WINDOW :])
    return (left, right) if left + WINDOW + right >= SPAN else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows sorted by key -> per key its distinct surroundings ``((doc, place, near), places in the document)``.

    A thin window stands in CROWD places at most; a document that holds it often,
    with the same text around, counts once.
    """
    key, held = None, {}
    for b in batches:
        for k, doc, at, place, near in zip(*(c.to_pylist() for c in b.columns)):
            if k != key:
                if len(held) > 1:
                    yield list(held.items())
                key, held = k, {}
            held.setdefault((doc, place, near), []).append(at)
    if len(held) > 1:
        yield list(held.items())


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> (a, b) of documents with a common stretch, once per stretch: at its first window."""
    a, b = [], []

    def out():
        r = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a.clear(), b.clear()
        return r

    for rows in _runs(batches):
        for i, ((da, pa_, na), _) in enumerate(rows):
            for (db, pb, nb), _ in rows[i + 1 :]:
                if da != db and (e := extent(na, pa_, nb, pb)) and e[0] < STEP:
                    a.append(min(da, db))
                    b.append(max(da, db))
        if len(a) > 4096:
            yield out()
    yield out()


def _extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> (doc_id, start, end): the widest stretch around each window that another document shares."""
    doc, lo, hi = [], [], []

    def out():
        r = pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["doc_id", "start", "end"])
        doc.clear(), lo.clear(), hi.clear()
        return r

    for rows in _runs(batches):
        for (da, pa_, na), places in rows:
            found = {e for (db, pb, nb), _ in rows if da != db and (e := extent(na, pa_, nb, pb))}
            for left, right in found:
                doc += [da] * len(places)
                lo += [at - left for at in places]
                hi += [at + WINDOW + right for at in places]
        if len(doc) > 4096:
            yield out()
    yield out()


def merged_sketch(hashed: DataFrame, cells: int) -> bytes:
    """The cells with two windows or more in the merged sketch of all partitions: 2 x ``cells`` bits."""
    n = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    form, size = "chunk int, one binary, two binary", CHUNK
    chunks = hashed.select("keys").mapInArrow(lambda it: _sketch(it, cells, size), form)
    merged = chunks.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(_merge, form)
    out, size = bytearray(2 * cells // 8), size // 8
    for chunk, part in merged.select("chunk", "two").toLocalIterator():
        out[chunk * size : (chunk + 1) * size] = part
    return bytes(out)


def hashed_windows(documents: DataFrame) -> DataFrame:
    """``(doc_id, digest, keys, ats)`` of the texts of SPAN code points or more: one scan, about a quarter of a byte a character."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where((F.length("text") >= SPAN) & F.col("doc_id").isNotNull())
    return stage(d.mapInArrow(_hashed, _HASHED), "hashed")


def copies(hashed: DataFrame) -> DataFrame:
    """``(doc_id, rep)`` of every text that is a copy of the one of ``rep``, the least id; ids and digests move, no text."""
    m = hashed.select("doc_id", "digest").distinct()
    rep = m.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("digest", "rep")
    return stage(m.join(rep, "digest").where("doc_id <> rep").select("doc_id", "rep"), "copies")


def open_windows(hashed: DataFrame, surplus: DataFrame) -> DataFrame:
    """``(key, doc_id, at)`` of windows of distinct texts that the sketch estimates twice or more.

    Where there are more windows than two for each of CELLS cells, the sketch
    would hold none back: it is left out, and the exact count alone decides, at
    20 bytes a window.
    """
    many = hashed.agg(F.sum(F.size("keys"))).first()[0] or 0
    left = hashed
    if many <= 2 * CELLS:
        cells = min(max(1 << (4 * many).bit_length(), CHUNK), max(CELLS, CHUNK))
        shared = hashed.sparkSession.sparkContext.broadcast(merged_sketch(hashed, cells))
        left = hashed.mapInArrow(lambda it: _open(it, shared), _HASHED)
    left = stage(left.join(surplus, "doc_id", "left_anti").select("doc_id", "keys", "ats"), "open")
    return left.select("doc_id", F.explode(F.arrays_zip("keys", "ats")).alias("w")).select(F.col("w.keys").alias("key"), "doc_id", F.col("w.ats").alias("at"))


def repeated_windows(documents: DataFrame, hashed: DataFrame, surplus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(thin, spans)``: windows of few places sorted by key, and the spans around crowded ones that stand in two documents or more."""
    rows = open_windows(hashed, surplus)
    often = rows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.count("*") > CROWD).alias("crowded")).where("lo < hi").select("key", "crowded")
    back = rows.join(often, "key").groupBy("doc_id").agg(F.collect_list(F.struct("at", "key", "crowded")).alias("found"))  # of one text
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= SPAN)
    around = stage(texts.join(back, "doc_id").select("doc_id", "text", "found").mapInArrow(_around, _ROWS), "windows")
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    thin = around.where("not crowded").select("key", "doc_id", "at", "place", "near").repartition(n, "key").sortWithinPartitions("key")
    return thin, around.where("crowded").select("key", "near", "doc_id", "at", "place")


def shared_pairs(thin: DataFrame, spans: DataFrame) -> DataFrame:
    """``(a, b)``, a < b, of distinct texts with a common stretch of SPAN code points.

    Two texts meet at a span only if the spans before it differ or are not
    there, so a common stretch costs one row and not one for each of its spans.
    """
    spans = spans.select("key", "near", "doc_id", "place").distinct()
    begins = spans.groupBy("key", "near").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("place").alias("p"), F.max("place").alias("q"))
    begins = begins.where("lo < hi and (p < q or p = -1)").select("key", "near")
    spans = stage(spans.join(begins, ["key", "near"], "left_semi"), "spans")
    far = spans.toDF("key", "near", "a", "pa").join(spans.toDF("key", "near", "b", "pb"), ["key", "near"])
    far = far.where("a < b and (pa <> pb or pa = -1)").select("a", "b")
    return thin.mapInArrow(_pairs, "a long, b long").unionByName(far).distinct()


def sharing_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id_a, doc_id_b)``, a < b: documents with a stretch of SPAN consecutive code points in common, copies included.

    Null and short texts have no such stretch.  Repeated rows of one document
    add nothing, nor do rows without id.  An empty table gives an empty result.
    """
    hashed = hashed_windows(documents)
    surplus = copies(hashed)
    links = stage(shared_pairs(*repeated_windows(documents, hashed, surplus)), "links")
    reps = surplus.select("rep").distinct()
    cls = surplus.unionByName(reps.select(F.col("rep").alias("doc_id"), "rep"))
    inside = cls.toDF("a", "rep").join(cls.toDF("b", "rep"), "rep").where("a < b").select("a", "b")
    x, y = cls.toDF("xa", "a"), cls.toDF("xb", "b")
    across = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("xa", "a").alias("a"), F.coalesce("xb", "b").alias("b"))
    both = across.unionByName(inside)
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def shared_stretches(documents: DataFrame) -> DataFrame:
    """``(doc_id, start, end)``: the maximal stretches of each document, of SPAN code points or more, that other documents hold too.

    Stretches that overlap or touch are merged, so the lengths of a document's
    rows add up to how much of it is shared.  A document with an exact copy is
    shared as a whole.  Null and short texts have none.
    """
    hashed = hashed_windows(documents)
    surplus = copies(hashed)
    thin, spans = repeated_windows(documents, hashed, surplus)
    held = spans.groupBy("key", "near").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key", "near")
    spans = spans.join(held, ["key", "near"], "left_semi")
    part = thin.mapInArrow(_extents, "doc_id long, start int, end int").unionByName(spans.select("doc_id", F.col("at").alias("start"), (F.col("at") + SPAN).alias("end")))
    twins = surplus.unionByName(surplus.select(F.col("rep").alias("doc_id"), "rep")).select("doc_id").distinct()
    whole = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("start"), F.length("text").alias("end")).join(twins, "doc_id", "left_semi")
    rows = part.join(twins, "doc_id", "left_anti").unionByName(whole).distinct()
    w = W.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("__before", before).withColumn("__new", F.when(F.col("__before").isNull() | (F.col("start") > F.col("__before")), 1).otherwise(0))
    marked = marked.withColumn("__i", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "__i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__i")


def shared_share(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, n_stretches, shared_chars, share)`` of every document; an empty or null text has share 0."""
    s = shared_stretches(documents).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("c"))
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")).join(s, "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return d.select("doc_id", "n_chars", zero("n").alias("n_stretches"), zero("c").alias("shared_chars"), F.round(F.coalesce(F.try_divide(F.col("c"), F.col("n_chars")), F.lit(0.0)), 6).alias("share"))
