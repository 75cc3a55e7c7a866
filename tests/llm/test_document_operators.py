"""Operators over documents: tokens, leakage, mixtures, shared spans. Each against plain Python or a library, and on awkward tables."""

import itertools
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapidary.functions.text import normalize_py
from lapidary.llm import leakage, mixing, shared_spans, tokens

VOCABULARY = "/opt/tokenizers"


def docs(spark, texts, extra=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for c in ("h", "rep", "key", "n", "start", "at") if extra else ():
        df = df.withColumn(c, F.lit("clash"))
    return df


# -- tokens

PIECES = [(0, "<pad>", 0.0), (1, "<s>", 0.0), (2, "</s>", 0.0), (3, "<unk>", 0.0)] + [(4 + i, f"<0x{i:02X}>", 0.0) for i in range(256)]
WORDS = ["▁", "a", "b", "▁a", "ab", "▁ab", "ba", "aba", "ⲁ", "▁ⲁb"]
PIECES += [(300 + i, w, -1.0 - 0.37 * i) for i, w in enumerate(WORDS)]


def best_path(t):
    """Token count of the best segmentation by trying all."""
    score = {w: s for _, w, s in PIECES[260:]}
    least = min(score.values()) - 10
    best = {0: (0.0, 0)}
    for i in range(1, len(t) + 1):
        cand = []
        for j in range(i):
            w = t[j:i]
            if w in score:
                cand.append((best[j][0] + score[w], best[j][1] + 1))
            elif len(w) == 1:
                cand.append((best[j][0] + least, best[j][1] + len(w.encode())))
        best[i] = max(cand, key=lambda c: c[0])
    return best[len(t)][1]


def test_unigram_counts():
    u = tokens.UnigramCounter(PIECES)
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("abcⲁ漢 ") for _ in range(rng.randint(0, 12)))
        assert u.count(t) == sum(best_path("▁" + w) for w in t.split())
    assert u.count("") == 0 and tokens.UnigramCounter([]).count("ab") == 3


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public vocabularies")
def test_bpe_counts_against_library():
    import tiktoken

    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        ranks = tokens.read_ranks(f"{VOCABULARY}/{name}")
        enc = tiktoken.Encoding("own", pat_str=tokens.BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        c = tokens.BpeCounter(ranks, tokens.BPE_PATTERN)
        rng = random.Random(2)
        for _ in range(300):
            t = "".join(rng.choice(["the", "ing", " ", "x", "ⲁ", "é", "\n", "12", "!", "aaaa", "qz", "漢"]) for _ in range(rng.randint(0, 25)))
            assert c.count(t) == len(enc.encode_ordinary(t)), t
        assert c.count("ab" * 3000) == len(enc.encode_ordinary("ab" * 3000))


def test_token_cube(spark, records):
    r = records([(0, "k", "d", {"text": "ab a", "translation_de": None}, {}), (1, "k", "d", {"translation_de": "b"}, {}), (2, "z", None, {"text": ""}, None)], extra=False)
    d = spark.createDataFrame([(0, "ab", "DE", "s", "x"), (1, None, None, None, None), (2, "", " und", None, None)], "doc_id long, text string, lang string, source string, domain string")
    c = spark.createDataFrame([("k", "text", "cop", "translation_de", "de", "rel")], "corpus string, primary_field string, primary_lang string, translation_field string, translation_lang string, domain string")
    p = spark.createDataFrame(PIECES, "piece_id int, piece string, score double")
    n = tokens.with_tokens(tokens.all_texts(r, d, c), "text", tokens.unigram_counter(p))
    got = {(x["origin"], x["id"], x["field"]): (x["slice"], x["lang"], x["domain"], x["tokens"]) for x in n.collect()}
    assert got == {
        ("records", 0, "text"): ("k", "cop", "rel", 2), ("records", 1, "translation_de"): ("k", "de", "rel", best_path("▁b")), ("records", 2, "text"): ("z", None, None, 0),
        ("documents", 0, "text"): ("s", "de", "x", 1), ("documents", 2, "text"): (None, None, None, 0),
    }
    cube = tokens.token_cube(n).collect()
    assert {x["origin"]: (x["n_texts"], x["n_tokens"]) for x in cube if x["grouping"] == 7} == {"records": (3, 2 + best_path("▁b")), "documents": (2, 1)}
    assert tokens.token_cube(n.limit(0)).count() == 0


# -- leakage


def runs(words, k=12):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_leaks_against_all_runs(spark, monkeypatch):
    monkeypatch.setattr(leakage, "PASSAGE", 20)
    rng = random.Random(3)
    word = lambda: rng.choice(["der", "und", *(f"w{i}" for i in range(25))])
    items = [" ".join(word() for _ in range(rng.randint(5, 30))) for _ in range(60)] + ["und " * 14, "", None]
    texts = []
    for _ in range(80):
        w = [word() for _ in range(rng.randint(0, 60))]
        src = (rng.choice(items) or "").split()
        n = rng.randint(9, 14)
        at = rng.randint(0, max(len(src) - n, 0))
        texts.append(" ".join(w[:20] + src[at : at + n] + w[20:]).upper())
    texts += ["und, und " * 7, "", None, "der " * 50_000, items[0]]
    it = [(i, set() if t is None else runs(normalize_py(t).split())) for i, t in enumerate(items)]
    want = {(d, i) for d, t in enumerate(texts) if t for i, r in it if r & runs(normalize_py(t).split())}
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    for block, dense in ((5000, 1 << 24), (7, 1 << 24), (5000, 200)):
        monkeypatch.setattr(leakage, "ITEMS", block)
        monkeypatch.setattr(leakage, "DENSE", dense)
        got = [tuple(r) for r in leakage.leaked_items(docs(spark, texts), table).collect()]
        assert set(got) == want and len(got) == len(want) and len(want) > 20
    assert leakage.leaked_items(docs(spark, texts).limit(0), table).count() == 0 and leakage.leaked_items(docs(spark, texts), table.limit(0)).count() == 0
    rep = leakage.leak_report(leakage.leaked_items(docs(spark, texts), table), docs(spark, texts).withColumn("source", F.lit(None).cast("string")))
    assert rep.first()["n_documents"] == len({d for d, _ in want})


# -- mixtures


def test_fill_against_all_subsets():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(0, 12): rng.randint(1, 3) for _ in range(4)}
        budget = rng.randint(0, 60)
        got = mixing.fill(counts, budget)
        total = sum(n * k for n, k in got.items())
        best = max(s for s in (sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*(range(c + 1) for c in counts.values()))) if s <= budget)
        assert all(0 <= k <= counts[n] for n, k in got.items()) and total == best
    big = {n: 1000 for n in range(50, 900)}
    for budget in (123_456_789, 7, 51):
        assert sum(n * k for n, k in mixing.fill(big, budget).items()) == (budget if budget > 50 else 0)


def test_fill_even_lengths_with_an_odd_rest():
    """No exact fill exists; the programme stops one token short without a table per step."""
    counts = {n: 1 for n in range(2, 80_002, 2)}
    total = sum(counts)
    got = mixing.fill(counts, total // 2 + (1 - total // 2 % 2))
    assert total // 2 - sum(n * k for n, k in got.items()) <= 1


def test_mixture(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "other"]), rng.choice([None, 0, 5, 17, 23])) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumn("rank", F.lit("clash"))
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 1), ("none", 0.0, 4)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixture(d, t)
    r = {x["source"]: x for x in report.collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2), ("none", 0.0)):
        assert abs(r[s]["actual_share"] - share) < 0.003 and r[s]["repeats_used"] <= r[s]["max_repeats"]
    have = Counter()
    for _, s, n in rows:
        have[s] += n or 0
    best = min(m * have[s] / w for s, w, m in (("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 1)))
    assert sum(x["n_tokens"] for x in r.values()) > 0.99 * best
    again = mixing.mixture(d.repartition(5), t)[0]
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))
    small = mixing.mixture(d, t, total=500)[1].agg(F.sum("n_tokens")).first()[0]
    assert 480 <= small <= 500
    gone = mixing.mixture(d, spark.createDataFrame([("a", 0.5, 1), ("zz", 0.5, 2)], t.schema))[1]
    assert {x["source"]: x["actual_share"] for x in gone.collect()} == {"a": 1.0, "zz": 0.0}
    assert mixing.mixture(d.limit(0), t)[0].count() == 0 and mixing.mixture(d, t.limit(0))[1].count() == 0


# -- shared spans


def spans(texts, n=300):
    at = defaultdict(set)
    for d, t in enumerate(texts):
        for i in range(len(t or "") - n + 1):
            at[t[i : i + n]].add(d)
    pairs = {p for ds in at.values() for p in itertools.combinations(sorted(ds), 2)}
    covered = {}
    for d, t in enumerate(texts):
        m = bytearray(len(t or ""))
        for i in range(len(t or "") - n + 1):
            if len(at[t[i : i + n]]) > 1:
                m[i : i + n] = b"\1" * n
        covered[d] = sum(m)
    return pairs, covered


def span_texts():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh \nⲁ𓀀") for _ in range(n))
    long, head = text(700), text(260)
    out = [text(500) + long[a:b] + text(200) for a, b in ((0, 300), (0, 299), (100, 400), (350, 700), (0, 700), (50, 351), (390, 690))]
    out += [head + text(rng.randint(0, 400)) for _ in range(12)]  # a header below the span
    out += [long, long, long[:-1], text(299), "", None, "=" * 900, "x" + "=" * 350, "=" * 299, ("ab" * 170) + text(30), text(20) + "ba" * 200, (text(250) + "\n") * 1 + text(100)]
    line = text(249) + "\n"
    out += [line * 9, text(40) + line * 4, line + text(90)]
    return out


@pytest.mark.parametrize("crowd", [32, 1])
def test_spans_against_all_windows(spark, crowd, monkeypatch):
    monkeypatch.setattr(shared_spans, "CROWD", crowd)
    monkeypatch.setattr(shared_spans, "CELLS", 1 << 16)
    texts = span_texts()
    want, covered = spans(texts)
    df = docs(spark, texts).repartition(3)
    got = [tuple(r) for r in shared_spans.sharing_documents(df).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20
    share = {r["doc_id"]: r for r in shared_spans.shared_share(df).collect()}
    assert {d: r["shared_chars"] for d, r in share.items()} == covered
    s = shared_spans.shared_stretches(df).collect()
    assert all(r["end"] - r["start"] >= 300 for r in s)
    assert shared_spans.sharing_documents(df.limit(0)).count() == 0 and shared_spans.shared_share(df.limit(0)).count() == 0


def test_windows_are_chosen_by_content():
    rng = np.random.default_rng(1)
    a = "".join(rng.choice(list("abcd"), 2000))
    for lo in range(0, 1500, 37):
        x, y = "zz" * 50 + a[lo : lo + 300] + "q" * 77, a[lo : lo + 300] + "kkk"
        assert set(shared_spans.windows(x)[1]) & set(shared_spans.windows(y)[1])
    assert len(shared_spans.windows(a * 20)[0]) < len(a * 20) / 25 and len(shared_spans.windows("a" * 299)[0]) == 0
    h = shared_spans.rolling(shared_spans._codes("abcabc"), 3)
    assert h[0] == h[3] != h[1] and len(shared_spans.rolling(shared_spans._codes("ab"), 3)) == 0


def test_hot_header(spark):
    """A stretch in a third of all documents, and one just too short."""
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    short, full = text(290), text(310)
    texts = [short + text(300) if i % 3 else text(30) + full + text(50) for i in range(150)]
    got = {tuple(r) for r in shared_spans.sharing_documents(docs(spark, texts)).collect()}
    assert got == set(itertools.combinations(range(0, 150, 3), 2))


def test_full_sketch_and_no_sketch(spark, monkeypatch):
    """Forty windows to a cell, then no sketch at all: the same pairs, and a row per window, never one per character."""
    texts = span_texts()
    want, _ = spans(texts)
    rng = random.Random(8)
    texts += ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(120)]
    df = docs(spark, texts)
    monkeypatch.setattr(shared_spans, "CHUNK", 1 << 7)
    hashed = shared_spans.hashed_windows(df)
    n = hashed.agg(F.sum(F.size("keys"))).first()[0]
    plain = shared_spans.merged_sketch
    for most, cells in ((1 << 26, 1 << 7), (1, None)):
        monkeypatch.setattr(shared_spans, "CELLS", most)
        monkeypatch.setattr(shared_spans, "merged_sketch", lambda h, c, cells=cells: plain(h, cells))
        assert cells is None or n / cells > 40
        rows = shared_spans.open_windows(hashed, shared_spans.copies(hashed)).count()
        assert rows < 0.05 * sum(len(t or "") for t in texts)
        assert {tuple(r) for r in shared_spans.sharing_documents(df).collect()} == want


def test_sketch_counts_ones_and_twos():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 400, 300) * 0x9E3779B97F4A7 for _ in range(3)]
    cells = shared_spans.CHUNK
    rows = []
    for p in parts:
        b = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, 100, 300], pa.int32()), pa.array(p))], names=["keys"])
        rows += list(shared_spans._sketch(iter([b]), cells, cells))
    rows.sort(key=lambda r: r.column(0)[0].as_py())
    merged = {r.column(0)[0].as_py(): r.column(2)[0].as_py() for r in shared_spans._merge(iter(rows))}
    h = np.concatenate(parts).view(np.uint64)
    for i, cell in enumerate(shared_spans._cells(h, cells)):
        want = np.bincount(cell, minlength=cells) > 1
        assert (np.unpackbits(np.frombuffer(merged[i], np.uint8)).astype(bool) == want).all()
