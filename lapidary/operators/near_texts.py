"""Passages with a training text within k = ``int(d · n)`` edits, n being the length of the passage.

A passage is cut into P disjoint pieces; each edit destroys at most one, so at
least P - k survive unchanged in the training text, moved by k positions at most.
A block of passages is indexed by (hash of a piece, place bucket); the windows of
a training text are looked up as arrays.  A piece that stands s positions off took
|s| edits before it, and the rest of the difference in length after it, which
drops most of what is met.  The pieces left are merged to a coverage per passage;
a passage covered by no less than its P - k shortest pieces is verified, by counts
of letters and then by edit distance, in the worker.  A passage that has been
found is not sought again there.

Shards hold a length band: a training text visits only the bands whose lengths
are within reach.  A heavy shard is divided further.  Its passages are written in
blocks of bounded size to the shared folder, a file each; its training texts move
once, in chunks, and a task takes the blocks of its shard one after the other.
So no text is copied for a block nor a passage for a chunk: the rows that move are
linear in the input, however the passages are divided.  The lookups are not: each
chunk is looked up in each block of its shard.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.session import shared_root

BAND = 1.22  # ratio of neighbouring length bands: 1.1 / 0.9, so with d = 0.1 a text reaches two or three
PASSAGES, LETTERS = 60_000, 6_000_000  # passages of a block, and their characters
TEXTS, CHARS = 40_000, 6_000_000  # training texts of a chunk, and their characters
WORK, GROUP, WINDOWS = 1_000_000, 200_000, 1 << 18  # postings, characters and windows that are held at a time
CELLS = 32  # letters are counted by hash

_ODD, _STEP, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def allowed(n: int, d: float) -> int:
    return int(d * n)


def pieces(n: int, k: int | None = None) -> list[tuple[int, int]]:
    """Disjoint pieces (start, end) of a passage of length n: k + 1, 2 or 3 of them."""
    k = n // 10 if k is None else k
    p = min(n, k + (1 if n < 20 else 2 if n < 60 else 3))
    cuts = [n * i // p for i in range(p + 1)]
    return list(zip(cuts, cuts[1:]))


def needed_coverage(n: int, k: int | None = None) -> int:
    """Characters that stay covered when the k longest pieces are destroyed."""
    lens = sorted(b - a for a, b in pieces(n, k))
    return sum(lens[: len(lens) - (n // 10 if k is None else k)])


@lru_cache(maxsize=10_000)
def _cut(n: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    p = np.array(pieces(n, k), np.int64)
    return p[:, 0], p[:, 1] - p[:, 0], needed_coverage(n, k)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * _ODD
    return z ^ (z >> np.uint64(29))


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, GROUP + 10_000)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x)])) for x in (_STEP, _BACK)]
    return _powers[0][:n], _powers[1][:n]


class Texts:
    """Texts laid end to end: code points, sums of the rolling hash, where each begins."""

    def __init__(self, texts: list[str]) -> None:
        self.size = np.array([len(t) for t in texts], np.int64)
        self.base = np.cumsum(self.size) - self.size
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        value = _mixed((code + np.uint64(1)) * _ODD)
        self.cell = (value >> np.uint64(59)).astype(np.int64)
        up, self.down = _power(len(code) + 1)
        self.sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(value * up[:-1], out=self.sums[1:])

    def window(self, at: np.ndarray, n) -> np.ndarray:
        """Hash of the n characters from ``at`` on, the same wherever they stand."""
        return (self.sums[at + n] - self.sums[at]) * self.down[at]

    def letters(self, which: np.ndarray) -> np.ndarray:
        """Counts of letters of the texts ``which``, a row each."""
        size = self.size[which]
        row = np.repeat(np.arange(len(which)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + self.base[which][row]
        return np.bincount(row * CELLS + self.cell[at], minlength=len(which) * CELLS).reshape(-1, CELLS)


def _key(h: np.ndarray, size, bucket: np.ndarray) -> np.ndarray:
    return _mixed(h + (bucket.astype(np.uint64) * np.uint64(1 << 20) + np.asarray(size).astype(np.uint64)) * _SALT)


def _ranges(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): ``many[i]`` places from ``first[i]`` on, for every row i."""
    row = np.repeat(np.arange(len(many)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]


class Index:
    """Pieces of the passages of one block by hash and place."""

    def __init__(self, passages: list[str], d: float) -> None:
        t = Texts(passages)
        self.texts, self.n = t, t.size
        self.k = np.array([allowed(n, d) for n in t.size.tolist()], np.int64)
        cuts = [_cut(n, k) for n, k in zip(t.size.tolist(), self.k.tolist())]
        self.need = np.array([c[2] for c in cuts], np.int64)
        many = np.array([len(c[0]) for c in cuts], np.int64)
        self.most, self.head_of = int(many.max()), np.cumsum(many) - many
        owner, number = _ranges(np.zeros(len(many), np.int64), many)
        start, size = np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts])
        self.owner, self.start, self.size, self.number = (x.astype(np.int32) for x in (owner, start, size, number))
        self.sizes = np.unique(size).tolist()
        self.width = max(4, int(self.k.max()))
        k = self.k[owner]
        low, high = np.maximum(start - k, 0) // self.width, (start + k) // self.width
        post, bucket = _ranges(low, high - low + 1)
        key = _key(t.window(t.base[owner] + start, size)[post], size[post], bucket)
        order = np.argsort(key)
        key, self.post = key[order], post[order].astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.keys, self.at = key[first], np.append(first, len(key))
        self.shift = np.uint64(64 - max(4, int(len(first)).bit_length() + 1))
        heads = np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))
        self.head = np.concatenate([[0], np.cumsum(heads)]).astype(np.int32)

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key number) of the keys that are there."""
        top = (key >> self.shift).astype(np.int64)
        at, end = self.head[top], self.head[top + 1]
        row, found = np.flatnonzero(at < end), []
        at, end, key = at[row], end[row], key[row]
        while len(row):
            same = self.keys[at] == key
            if same.any():
                found.append((row[same], at[same]))
            on = ~same & (at + 1 < end)
            row, at, end, key = row[on], at[on] + 1, end[on], key[on]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))

    def candidates(self, texts: list[str], done: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (text, passage not yet done) whose coverage suffices and whose letters can be near, in blocks of bounded work."""
        t, hits = Texts(texts), []
        total = int(t.size.sum())
        for a in range(0, total, WINDOWS):
            at = np.arange(a, min(a + WINDOWS, total))
            text = np.searchsorted(t.base, at, side="right") - 1
            place = at - t.base[text]
            left = t.size[text] - place
            for size in self.sizes:
                ok = np.flatnonzero(left >= size)
                row, key = self._find(_key(t.window(at[ok], size), size, place[ok] // self.width))
                row = ok[row]
                hits.append((text[row], place[row], key))
        if not hits:
            return
        text, place, key = (np.concatenate(x) for x in zip(*hits))
        order = np.argsort(text, kind="stable")
        text, place, key = text[order], place[order], key[order]
        first = self.at[key]
        many = self.at[key + 1] - first
        work = np.cumsum(many)
        lo = 0
        while lo < len(text):  # whole texts until their postings exceed WORK; a single text may exceed it
            hi = int(np.searchsorted(work, (work[lo - 1] if lo else 0) + WORK, side="right"))
            if hi < len(text):
                hi = int(np.searchsorted(text, text[hi], side="left"))
                if hi <= lo:
                    hi = int(np.searchsorted(text, text[lo], side="right"))
            yield self._covered(t, text[lo:hi], place[lo:hi], first[lo:hi], many[lo:hi], done)
            lo = hi

    def _covered(self, t: Texts, text, place, first, many, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, at = _ranges(first, many)
        post = self.post[at]
        owner = self.owner[post]
        k, off = self.k[owner], place[row] - self.start[post]
        rest = t.size[text[row]] - self.n[owner] - off
        ok = np.flatnonzero((np.abs(off) + np.abs(rest) <= k) & ~done[owner])
        # a piece counts once for a pair, however often it matched
        z = np.unique((text[row[ok]] * len(self.n) + owner[ok]) * self.most + self.number[post[ok]])
        if not len(z):
            return z, z
        pair, number = z // self.most, z % self.most
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        pair, many = pair[new], np.diff(np.append(new, len(z)))
        text, owner = pair // len(self.n), pair % len(self.n)
        size = self.size[np.repeat(self.head_of[owner], many) + number]
        good = np.add.reduceat(size, new) >= self.need[owner]
        text, owner = text[good], owner[good]
        near = [np.zeros(0, bool)]
        step = max(1, WORK // (int(self.n.max()) * 2 + CELLS))
        for a in range(0, len(text), step):  # each edit takes one letter away at most, and adds one at most
            x, y = text[a : a + step], owner[a : a + step]
            apart = t.letters(x) - self.texts.letters(y)
            near.append((np.maximum(apart, 0).sum(axis=1) <= self.k[y]) & (np.maximum(-apart, 0).sum(axis=1) <= self.k[y]))
        near = np.concatenate(near)
        return text[near], owner[near]


class Pattern:
    """Edit distance to one passage, bit-parallel over the passage (Myers 1999)."""

    def __init__(self, t: str) -> None:
        self.n, self.at = len(t), {}
        for i, c in enumerate(t):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def within(self, t: str, k: int) -> bool:
        n, at, score, left = self.n, self.at, self.n, len(t)
        if abs(n - left) > k or not n:
            return abs(n - left) <= k
        full, last = (1 << n) - 1, 1 << (n - 1)
        up, down = full, 0  # places where the column rises and falls
        for c in t:
            eq = at.get(c, 0)
            diag = (((eq & up) + up) ^ up) | eq | down
            rise, fall = down | (full & ~(diag | up)), up & diag
            score += bool(rise & last) - bool(fall & last)
            left -= 1
            if score - left > k:
                return False
            rise, fall = rise << 1 | 1, fall << 1
            up = (fall | ~((eq | down) | rise)) & full
            down = rise & (eq | down) & full
        return score <= k


class Block:
    """The passages of one file that are still sought."""

    def __init__(self, passages: list[str], ids: list, d: float = 0.1) -> None:
        self.passages, self.ids, self.d = passages, ids, d
        self._index()

    def _index(self) -> None:
        self.index = Index(self.passages, self.d) if self.passages else None
        self.done, self.patterns = np.zeros(len(self.passages), bool), {}

    def search(self, texts: list[str]) -> Iterator:
        """Ids of passages found in ``texts``, each once."""
        if not self.passages:
            return
        for t, p in self.index.candidates(texts, self.done):
            for x, i in zip(t.tolist(), p.tolist()):
                if self.done[i]:
                    continue
                pattern = self.patterns.get(i) or self.patterns.setdefault(i, Pattern(self.passages[i]))
                if pattern.within(texts[x], int(self.index.k[i])):
                    self.done[i] = True
                    self.patterns.pop(i)
                    yield self.ids[i]
                elif len(self.patterns) * len(self.passages[i]) > CHARS:
                    self.patterns.clear()
        if self.done.sum() * 2 > len(self.done) > 32:
            left = np.flatnonzero(~self.done).tolist()
            self.passages, self.ids = [self.passages[i] for i in left], [self.ids[i] for i in left]
            self._index()


def read_block(folder: str, number: int, d: float) -> Block:
    """Block ``number`` of the folder ``write_blocks`` has written; any file system Arrow knows by its scheme."""
    from pyarrow import fs, parquet

    if folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = folder.replace("file:/", "file:///", 1)
    system, path = fs.FileSystem.from_uri(f"{folder}/block={number}")
    if system.get_file_info(path).type == fs.FileType.NotFound:  # no passage fell into it
        return Block([], [], d)
    t = parquet.read_table(path, filesystem=system, columns=["norm", "h"], partitioning=None)
    return Block(t.column("norm").to_pylist(), t.column("h").to_pylist(), d)


def groups(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in lists of about GROUP characters."""
    out, chars = [], 0
    for t in texts:
        if out and chars + len(t) > GROUP:
            yield out
            out, chars = [], 0
        out.append(t)
        chars += len(t)
    if out:
        yield out


def scan(batches: Iterator[pa.RecordBatch], folder: str, plan: list[tuple[int, int, int]], most: tuple[int, int], d: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(unit, text) sorted by unit -> ids of the passages found; ``plan`` has (first unit, first block, blocks) of each shard."""
    first, unit, texts, chars, blocks = [p[0] for p in plan], None, [], 0, {}

    def flush() -> Iterator[pa.RecordBatch]:
        if not texts:
            return
        _, block, n = plan[bisect_right(first, unit) - 1]
        for i in range(block, block + n):
            b = blocks.get(i)
            if b is None:
                blocks.clear()  # one index at a time
                b = blocks[i] = read_block(folder, i, d)
            found = [h for some in groups(texts) for h in b.search(some)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, kind)], names=["h"])
        texts.clear()

    for b in batches:
        for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if u != unit or len(texts) >= most[0] or chars >= most[1]:
                yield from flush()
                unit, chars = u, 0
            texts.append(t)
            chars += len(t)
    yield from flush()


def band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")


def write_blocks(passages: DataFrame, reach: DataFrame, shard: list[str], limits: tuple[int, int, int, int]) -> tuple[str, DataFrame, list[tuple[int, int, int]]]:
    """Blocks of passages as files, training texts as ``(unit, norm)`` rows, one a text and band, and the plan of both.

    The plan has a row for each shard, which does not grow with the rows.
    ``limits``: PASSAGES, LETTERS, TEXTS, CHARS.
    """
    spark = passages.sparkSession
    ne = passages.groupBy(*shard).agg(F.count("*").alias("ne"), F.sum("n").alias("letters"))
    nt = reach.groupBy(*shard).agg(F.count("*").alias("nt"), F.sum("n").alias("chars"))
    rows, units, blocks = [], 0, 0
    for s in sorted(ne.join(nt, shard).collect(), key=lambda s: tuple(s[c] for c in shard)):
        es, tc = max(-(-s.ne // limits[0]), -(-s.letters // limits[1])), max(-(-s.nt // limits[2]), -(-s.chars // limits[3]))
        rows.append((*(s[c] for c in shard), es, tc, units, blocks))
        units, blocks = units + tc, blocks + es
    kinds = [f"{c} {passages.schema[c].dataType.simpleString()}" for c in shard]
    p = F.broadcast(spark.createDataFrame(rows, ", ".join([*kinds, "es int", "tc int", "unit int", "block int"])))
    pick = lambda c: F.pmod(F.xxhash64("h"), F.col(c)).cast("int")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{shared_root(spark)}/blocks-{uuid.uuid4().hex[:8]}"
    e = passages.join(p, shard).select((F.col("block") + pick("es")).alias("block"), "norm", "h")
    e.repartition(max(n, min(blocks, 10_000)), "block").write.option("compression", "zstd").partitionBy("block").parquet(folder)
    t = reach.join(p, shard).select((F.col("unit") + pick("tc")).alias("unit"), "norm")
    t = t.repartition(max(n, min(units, 100_000)), "unit").sortWithinPartitions("unit")
    return folder, t, [(r[-2], r[-1], r[-4]) for r in rows]


def reaching(texts: DataFrame, d: float, least: int) -> DataFrame:
    """``texts(n, …)``, a row for each ``band`` of passages of ``least`` characters or more that it can be near to."""
    low, high = F.floor(F.col("n") / (1 + d)), F.ceil(F.col("n") / (1 - d))
    return texts.withColumn("band", F.explode(F.sequence(band(F.greatest(low, F.lit(least))), band(F.greatest(high, F.lit(least))))))


def near(passages: DataFrame, reach: DataFrame, shard: list[str], d: float, limits: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``(h)`` of the passages ``(*shard, norm, h, n)`` with a text of ``reach(*shard, norm, h, n)``, of their shard, within ``int(d · n)`` edits."""
    from pyspark.sql.pandas.types import to_arrow_type

    limits = limits or (PASSAGES, LETTERS, TEXTS, CHARS)
    h = passages.schema["h"].dataType
    folder, t, plan = write_blocks(passages, reach, shard, limits)
    kind, most = to_arrow_type(h), limits[2:]
    return t.mapInArrow(lambda it: scan(it, folder, plan, most, d, kind), f"h {h.simpleString()}").distinct()
