"""Operators over records: groups, lookalikes, cross-split overlap, near duplicates, terms. Each against plain Python, and on awkward tables."""

import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapidary.functions.text import normalize_py
from lapidary.llm import cross_split, lookalike, near_dup, splits, term_counts
from lapidary.llm.components import connected_components
from lapidary.operators import near_texts

LONG = "wort " * 40_000


@pytest.fixture
def awkward(records):
    """Nulls in every column, empty, blank, very long and repeated values, clashing column names."""
    keys = ("text", "hieroglyphs", "transliteration", "translation_de")
    rows = [(i, "c", "d", {k: v for k in keys}, {"authors": v}) for i, v in enumerate((None, "", "  ", "!!", LONG, "<g></g>", "\x00​"))]
    rows += [(20, None, None, None, None), (21, "c", None, {}, {}), (4, "c", "d", {k: LONG for k in keys}, None), (22, "c", "d", {"text": LONG}, {"authors": ";;"})]
    return records(rows, extra=True)


# -- groups and splits


def test_keys():
    assert splits.document_key("cs․roll00037 ") == splits.document_key("CS/ROLL37") == splits.document_key("cs.roll0037")
    assert splits.document_key("P１０２１１４") == splits.document_key("p-102114") and splits.document_key("d00106") != splits.document_key("d00016")
    assert splits.document_key("x0") == "x0" and splits.document_key("x000") == "x0" and splits.document_key(None) is None
    assert splits.editor_keys("Berg, Ivo;IVO  berg; N. N.; - ;unknown;n/a;anon.;") == ["berg ivo"]
    assert splits.editor_keys("Karmüdahl A") == splits.editor_keys("A karmüdahl") and splits.editor_keys(None) == []


def union_find(rows):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    node = lambda o, c, d: ("d", c, splits.document_key(d)) if d is not None else ("o", o)
    for o, c, d, _, m in rows:
        find(node(o, c, d))
        for e in splits.editor_keys((m or {}).get("authors")):
            p[find(node(o, c, d))] = find(("e", e))
    groups = defaultdict(list)
    for o, c, d, _, _ in rows:
        groups[find(node(o, c, d))].append((o, c, d))
    return groups.values()


def graph_rows(seed, n=150):
    rng = random.Random(seed)
    who = lambda: rng.choice(["A B", "b, a", "C D", "x y", "E", "-", "", "unknown"]) if rng.random() < 0.2 else f"P Q{rng.randrange(60)}"
    return [(i, rng.choice("kl"), None if rng.random() < 0.05 else rng.choice(["d1", "D-1", "d01", f"d{rng.randrange(80)}"]), {}, {"authors": ";".join(who() for _ in range(rng.randrange(3)))}) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_union_find(records, seed):
    rows = graph_rows(seed)
    want = {(o, min(x[0] for x in g)) for g in union_find(rows) if len({x[1:] for x in g}) > 1 for o, *_ in g}
    assert {tuple(r) for r in splits.linked_records(records(rows, extra=True)).collect()} == want and want


def test_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(4).shuffle(order)
    e = spark.createDataFrame(list(zip(order, order[1:])) + [(5, 5), (None, 3), (1000, 1001), (1001, 1000)], "u long, v long")
    got = {r[0]: r[1] for r in connected_components(e).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}
    assert connected_components(e.limit(0)).count() == 0


def test_split_keeps_groups_and_shares(records):
    rows = [(i, "c", f"doc{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i // 3 % 5}", {}, {}) for i in range(3000)]
    out = splits.balanced_split(records(rows))
    got = {r["ord"]: (r["group_ord"], r["part"]) for r in out.collect()}
    assert len(got) == 3000
    per = defaultdict(set)
    for g, p in got.values():
        per[g].add(p)
    assert all(len(x) == 1 for x in per.values())
    n = Counter(p for _, p in got.values())
    assert abs(n["train"] - 2400) <= 30 and abs(n["valid"] - 300) <= 30 and abs(n["test"] - 300) <= 30
    again = {r["ord"]: r["part"] for r in splits.balanced_split(records(rows).repartition(5)).collect()}
    assert again == {o: p for o, (_, p) in got.items()}
    r = {x["part"]: x for x in splits.split_report(out, records(rows)).collect()}
    assert abs(r["train"]["share"] - n["train"] / 3000) < 1e-6


def test_largest_differencing():
    parts = splits.largest_differencing([(w, w) for w in (8, 7, 6, 5, 4)], 2)
    assert sorted(sum(p) for p in parts) == [14, 16]  # the known result of the differencing of 8 7 6 5 4
    placed, part = splits.plan_bins([(1, 100), (50, 3)], {"train": 0.8, "valid": 0.1, "test": 0.1}, 10)
    assert len(part) == 10 and {w for w, *_ in placed} <= {1, 50}
    assert splits.plan_bins([], {"train": 1.0}, 4)[0] == []
    with pytest.raises(ValueError):
        splits.balanced_split(None, {"train": 0.5})


def test_differencing_with_one_heavy_group():
    """The work of a step does not grow with what the bins hold."""
    import time

    took = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        bins = splits.largest_differencing([(n * 50, "heavy"), *((i % 97 + 1, i) for i in range(n))], 20)
        took.append(time.perf_counter() - began)
        assert sorted(map(str, (x for b in bins for x in b))) == sorted(map(str, ["heavy", *range(n)]))
    assert took[1] < 10 * took[0] + 0.5


def test_groups_of_awkward_tables(records, awkward):
    splits.linked_records(awkward).count()
    assert splits.balanced_split(awkward).select("ord").distinct().count() == awkward.select("ord").distinct().count() - awkward.where("corpus is null").count()
    assert splits.linked_records(records([])).count() == 0 and splits.balanced_split(records([])).count() == 0


# -- lookalikes


def test_forms():
    f = lookalike.consistent_form
    same = [("ａｂ－１", "ab-1"), ("é", "é"), ("a​b­", "ab"), ("a b", "a b"), ("a　b", "a b"), ("сор", "cop"), ("ре́", "pé"), ("λόγοѕ", "λόγos"), ("ⲁⲟⲥ", "ⲁос"), ("אָ", "אָ"), ("j̱ј", "ј̱j")]
    for a, b in same:
        assert f(a) == f(b), (a, b)
    for a, b in [("a", "A"), ("a,", "a"), ("e", "é"), ("a2", "a₂"), ("a  b", "a b"), ("a2", "a²"), ("χ", "x"), ("ba", "ab")]:
        assert f(a) != f(b), (a, b)
    assert f("λоγος") == "λογος" and f("ⲁо") == "ⲁⲟ" and f("mаt") == "mat" and f("о ⲁⲃⲅ") == f("o ⲁⲃⲅ")
    assert f("") == "" and f(None) is None and f("​") == "" and f("  ") == "  "
    assert lookalike.resolve("mаt")[0] == "single" and lookalike.resolve("сор")[0] == "whole" and lookalike.resolve("λm")[0] == "plain" and lookalike.resolve("шfо")[0] == "mixed" and lookalike.resolve("шlо")[0] == "single"


def test_letters_of_other_alphabets():
    f = lookalike.consistent_form
    for a, b in zip("ӏօոᎪꓐɑɡսᏟᴏәз", "lonABaguCoəɜ"):
        assert f(f"x{a}") == f(f"x{b}") and f(a) == f(b), (a, b)
    for a, b in ["αa", "χx", "lI", "oO", "вB", "ηn", ("ո", "ո̈")]:
        assert f(a) != f(b), (a, b)
    assert len(lookalike.CLASS_OF) == sum(map(len, lookalike._LINES))  # no letter stands in two classes
    assert all(c == unicodedata.normalize("NFD", c) for c in lookalike.CLASS_OF)


def skeleton(v):
    """What a value looks like: marks apart, every look-alike by its class."""
    v = unicodedata.normalize("NFD", v.translate(lookalike._plain))
    return tuple(lookalike.CLASS_OF.get(c, c) for c in v)


def test_forms_agree_with_looks():
    """Equal forms are equal looks and the other way round, on random mixtures."""
    rng = random.Random(8)
    chars = ["a", "а", "o", "о", "ο", "ⲟ", "m", "λ", "ш", "ⲁ", " ", " ", "​", "ａ", "é", "é", "е́", "2", "₂", "p", "ρ"]
    vals = {"".join(rng.choice(chars) for _ in range(rng.randint(1, 4))) for _ in range(3000)}
    form, look = {v: lookalike.consistent_form(v) for v in vals}, {v: skeleton(v) for v in vals}
    by_look, by_form = defaultdict(set), defaultdict(set)
    for v in vals:
        by_look[look[v]].add(form[v])
        by_form[form[v]].add(look[v])
    assert all(len(x) == 1 for x in by_look.values()) and all(len(x) == 1 for x in by_form.values())
    assert all(lookalike.consistent_form(x) == x for x in form.values())


def test_lookalike_pairs(records, awkward):
    vals = ["cop x", "сор x", "cop x", "cop x", "cop y", "ab", "ａb", "", None, "​", "!", "！"]
    rows = [(i, "c", "d", {"text": v, "other": v}, {}) for i, v in enumerate(vals)]
    rows.append(rows[0])
    want = {("text", a, b) for a in range(12) for b in range(a + 1, 12) if (x := vals[a]) and (y := vals[b]) and x != y and skeleton(x) == skeleton(y) and normalize_py(x) and normalize_py(y)}
    got = [tuple(r) for r in lookalike.lookalike_pairs(records(rows, extra=True)).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) == 6
    lookalike.lookalike_pairs(awkward).count()
    assert lookalike.consistent_values(awkward).where("form is null").count() == 0
    assert lookalike.lookalike_pairs(records([])).count() == 0 and lookalike.consistent_values(records([])).count() == 0


# -- cross-split overlap


def edits(rng, t, n, alphabet):
    t = list(t)
    for _ in range(n):
        i, how = rng.randrange(len(t) + 1), rng.randrange(3)
        if how == 0:
            t.insert(i, rng.choice(alphabet))
        elif i < len(t):
            t[i : i + 1] = [] if how == 1 else [rng.choice(alphabet)]
    return "".join(t)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("alphabet", ["abcdefgh ", "ab"])
def test_overlap_against_all_pairs(spark, records, alphabet, monkeypatch):
    monkeypatch.setattr(cross_split, "PASSAGES", 7)
    monkeypatch.setattr(cross_split, "TEXTS", 9)
    rng = random.Random(len(alphabet))
    base = ["".join(rng.choice(alphabet) for _ in range(rng.choice([5, 9, 10, 11, 19, 20, 39, 40, 61, 120]))) for _ in range(30)]
    rows, part = [], {}
    for i in range(150):
        t = rng.choice(base)
        rows.append((i, rng.choice("kl"), "d", {"text": edits(rng, t, rng.randint(0, len(t) // 7 + 1), alphabet)}, {}))
        part[i] = rng.choice(["train", "train", "valid", "test", None])
    p = spark.createDataFrame([(o, x, "clash") for o, x in part.items() for _ in (0, 1)], "ord long, part string, corpus string")
    train = defaultdict(set)
    for o, c, _, f, _ in rows:
        if part[o] == "train" and normalize_py(f["text"]):
            train[c].add(normalize_py(f["text"]))
    want = set()
    for o, c, _, f, _ in rows:
        n = normalize_py(f["text"])
        if part[o] in ("valid", "test") and n and any(abs(len(n) - len(t)) <= len(n) // 10 and distance(n, t) <= len(n) // 10 for t in train[c]):
            want.add(("text", o))
    got = {(r["field"], r["ord"]) for r in cross_split.affected(records(rows, extra=True), p).collect()}
    assert got == want and len(want) > 10


def test_texts_move_once(spark):
    """Small blocks and chunks leave the number of rows that move as it is."""
    rng = random.Random(3)
    rows = [("c", "text", "".join(rng.choice("abcdef") for _ in range(rng.randint(30, 40))), i) for i in range(300)]
    d = spark.createDataFrame(rows, "corpus string, field string, norm string, i int").withColumn("n", F.length("norm")).withColumn("h", F.unhex(F.md5("norm")))
    d = d.withColumn("band", F.lit(17))
    e, t = d.where("i % 3 = 0"), d.where("i % 3 > 0")
    counts = {}
    for passages, texts in ((7, 9), (10_000, 10_000)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(cross_split, "PASSAGES", passages)
            m.setattr(cross_split, "TEXTS", texts)
            folder, rows_, plan = cross_split.write_blocks(e, t)
            counts[passages] = (spark.read.parquet(folder).count(), rows_.count())
            assert plan[0][2] == -(-100 // passages) and rows_.select("unit").distinct().count() <= -(-200 // texts)
    assert counts[7] == counts[10_000] == (100, 200)


def test_bounded_distance():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
    for _ in range(300):
        a = word()
        b = edits(rng, a, rng.randint(0, 12), "abc") if rng.random() < 0.7 else word()
        for k in (0, 1, 4, 9):
            assert cross_split.Pattern(a).within(b, k) == (distance(a, b) <= k)


def test_found_passages_are_not_sought_again():
    block = cross_split.Block([f"{'x' * 30}{i:03d}" for i in range(100)], [bytes([i]) for i in range(100)])
    assert len(list(block.search(["x" * 30 + "000"]))) == 100 and not len(block.passages)
    assert list(block.search(["x" * 30 + "001"])) == []


def test_pieces_meet_only_in_their_place(monkeypatch):
    """A phrase that every passage has somewhere is met only where it stands within k places; a block holds all of them."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklm") for _ in range(n))
    phrase, met = word(30), []
    passages = [word(a) + phrase + word(170 - a) for a in range(0, 170, 2)]
    text = passages[40][:60] + "x" + passages[40][60:]
    index = near_texts.Index(passages, 0.1)
    covered = near_texts.Index._covered
    monkeypatch.setattr(near_texts.Index, "_covered", lambda self, t, text, place, first, many, done: met.append((len(text), many.sum())) or covered(self, t, text, place, first, many, done))
    got = [(x, y) for t, p in index.candidates([text], np.zeros(len(passages), bool)) for x, y in zip(t.tolist(), p.tolist())]
    assert (0, 40) in got and len(got) < 10  # before the edit distance
    # the phrase has 2 pieces or more of 9 or 8 characters in each of the 85 passages, of which a fifth stand near
    assert 0 < sum(m for _, m in met) < 85 * 2
    assert cross_split.PASSAGES >= 50_000


def test_pieces():
    for n in range(10, 700):
        p = cross_split.pieces(n)
        assert p[0][0] == 0 and p[-1][1] == n and all(a < b for a, b in p) and len(p) > n // 10 and cross_split.needed_coverage(n) > 0


def test_overlap_of_awkward_tables(spark, records, awkward):
    p = spark.createDataFrame([(i, "train" if i % 2 else "test") for i in range(8)] + [(22, "test"), (20, "train"), (None, "x"), (3, None)], "ord long, part string")
    got = {(r["field"], r["ord"]) for r in cross_split.affected(awkward, p).collect()}
    assert got == set()
    p2 = spark.createDataFrame([(4, "train"), (22, "test")], "ord long, part string")
    f = cross_split.affected(awkward, p2)
    assert {(r["field"], r["ord"]) for r in f.collect()} == {("text", 22)}
    assert cross_split.overlap_report(f).where("part is null and corpus is null and field is null").first()["n_records"] == 1
    assert cross_split.affected(records([]), p).count() == 0 and cross_split.affected(awkward, p.limit(0)).count() == 0


# -- near duplicates


def jaccard_pairs(rows, field, least=8):
    v = [(o, set(normalize_py(f[field]).split())) for o, _, _, f, _ in rows if f.get(field) and len(normalize_py(f[field]).split()) >= least]
    return {(field, min(a, b), max(a, b)) for i, (a, x) in enumerate(v) for b, y in v[i + 1 :] if a != b and 10 * len(x & y) >= 7 * len(x | y)}


@pytest.mark.parametrize("vocabulary,crowd", [(400, 256), (12, 2), (3, 1)])
def test_similar_against_all_pairs(records, vocabulary, crowd):
    rng = random.Random(vocabulary)
    base = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(6, 16))] for _ in range(25)]
    rows = []
    for i in range(160):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            how = rng.randrange(3)
            if how == 0:
                t.insert(rng.randrange(len(t) + 1), f"w{rng.randrange(vocabulary)}")
            elif how == 1 and len(t) > 2:
                t.pop(rng.randrange(len(t)))
            else:
                rng.shuffle(t)
        rows.append((i, "c", "d", {rng.choice(["translation_de", "transliteration"]): " ".join(t).upper() + "!"}, {}))
    want = jaccard_pairs(rows, "translation_de") | jaccard_pairs(rows, "transliteration")
    member, cl = near_dup.classes(records(rows, extra=True))
    links = near_dup.similar_classes(cl, crowd=crowd)
    rep = {(r["field"], r["ord"]): r["rep"] for r in member.collect()}
    linked = {tuple(r) for r in links.collect()}
    got = {(f, min(a, b), max(a, b)) for (f, a), x in rep.items() for (g, b), y in rep.items() if f == g and a < b and (x == y or (min(x, y), max(x, y)) in linked)}
    assert got == want and want
    assert {tuple(r) for r in near_dup.similar_records(records(rows)).collect()} == want
    g = {(r["field"], r["ord"]): r for r in near_dup.near_duplicate_groups(records(rows)).collect()}
    assert set(g) == {(f, o) for f, a, b in want for o in (a, b)}
    assert all(g[f, a]["group_ord"] == g[f, b]["group_ord"] for f, a, b in want)


def test_crowded_keys_are_divided(records):
    """One stock phrase in all values: no two blocks of more than the limit meet in a task, and the pairs are right."""
    rng = random.Random(5)
    stock = [f"s{i}" for i in range(7)]
    rows = [(i, "c", "d", {"translation_de": " ".join(stock + [f"w{i % 40}", f"v{rng.randrange(6)}"])}, {}) for i in range(90)]
    for crowd in (2, 8):
        _, cl = near_dup.classes(records(rows))
        rep = {r["rep"]: set(r["words"]) for r in cl.collect()}
        want = {(a, b) for a, x in rep.items() for b, y in rep.items() if a < b and 10 * len(x & y) >= 7 * len(x | y)}
        assert {tuple(r) for r in near_dup.similar_classes(cl, crowd=crowd).collect()} == want and want


def test_pairs_that_differ_too_much_are_not_listed():
    """Values that share a key and nothing else do not leave the worker; similar ones all do."""
    import pyarrow as pa
    from fractions import Fraction

    rng = np.random.default_rng(4)
    t, base = Fraction("0.7"), rng.integers(-(2**62), 2**62, (40, 12))
    sets = [np.unique(np.concatenate([b[:10], [b[10 + i]]])) for b in base for i in (0, 1)] + [np.unique(b[:n]) for b in base for n in (9, 12)]
    off = np.cumsum([0, *map(len, sets)])
    sig = near_dup._signature(np.concatenate(sets), off)
    n, reps = np.diff(off), np.arange(len(sets)) * 2
    b = pa.RecordBatch.from_arrays([pa.array(np.full(len(sets), 7)), pa.array(reps), pa.array(n.astype(np.int32)), pa.array(sig)], names=["key", "rep", "n", "sig"])
    got = {(x // 2, y // 2) for o in near_dup._tally(iter([b]), t, 2, None) for x, y in zip(o["a"].to_pylist(), o["b"].to_pylist())}
    near = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 7 * len(np.union1d(sets[i], sets[j]))}
    assert near <= got and len(near) > 100 and len(got) < len(near) + 50  # of 12,720 pairs
    assert near_dup._signature(np.zeros(0, np.int64), np.zeros(3, np.int64)).tolist() == [0, 0]


def test_tally_over_batches():
    """Runs of a key across batches of any size; crowded keys come out as rows."""
    import numpy as np
    import pyarrow as pa
    from fractions import Fraction

    rng = np.random.default_rng(1)
    for crowd, size in [(c, s) for c in (None, 1, 3, 100) for s in (1, 2, 7, 100)]:
        n = int(rng.integers(0, 60))
        k, r, w = np.sort(rng.integers(0, 6, n)), rng.integers(0, 1000, n) * 2, np.full(n, 10, np.int32)
        batches = (pa.RecordBatch.from_arrays([pa.array(k[i : i + size]), pa.array(r[i : i + size]), pa.array(w[i : i + size])], names=["key", "rep", "n"]) for i in range(0, n, size))
        rows = [x for b in near_dup._tally(batches, Fraction(7, 10), 2, crowd) for x in zip(*(c.to_pylist() for c in b.columns))]
        many = Counter(k.tolist())
        assert sorted((x[2], x[0]) for x in rows if x[1] == -1) == sorted((a, b) for a, b in zip(k.tolist(), r.tolist()) if crowd and many[a] > crowd)
        want = {(min(r[i], r[j]), max(r[i], r[j])) for i in range(n) for j in range(i + 1, n) if k[i] == k[j] and r[i] != r[j] and not (crowd and many[int(k[i])] > crowd)}
        assert {(x[0], x[1]) for x in rows if x[1] != -1} == want


def test_similar_awkward(records, awkward):
    got = {tuple(r) for r in near_dup.similar_records(awkward).collect()}
    assert got == set()
    near_dup.near_duplicate_groups(awkward).count()
    assert near_dup.similar_records(records([])).count() == 0 and near_dup.near_duplicate_groups(records([])).count() == 0
    same = records([(i, "c", "d", {"translation_de": "a b c d e f g h"}, {}) for i in (0, 1, 2, 2)])
    assert {tuple(r) for r in near_dup.similar_records(same).collect()} == {("translation_de", 0, 1), ("translation_de", 0, 2), ("translation_de", 1, 2)}


# -- terms


@pytest.mark.parametrize("burst,routes,held", [(2048, 512, 400_000), (3, 8, 50)])
def test_terms_against_counters(records, burst, routes, held, monkeypatch):
    for k, v in (("BURST", burst), ("ROUTES", routes), ("HELD", held)):
        monkeypatch.setattr(term_counts, k, v)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abⲁ\U00013000") for _ in range(rng.randint(1, 5)))
    rows = [(i, "c", "d", {"text": " ".join(["und", *(word() for _ in range(rng.randint(0, 8)))]), "hieroglyphs": "\U00013001<g>A1</g>\U00013001 x <g></g>" + word()}, {}) for i in range(120)]
    rows += [(200, "c", "d", {"text": "", "hieroglyphs": None}, {}), (201, "c", "d", {"text": "   "}, {}), (0, *rows[0][1:])]
    occ, rec, filled = Counter(), Counter(), Counter()
    for _, _, _, f, _ in rows:
        for field, v in f.items():
            if v:
                filled[field] += 1
                ts = v.split() if field == "text" else term_counts.signs(v)
                occ.update((field, t) for t in ts)
                rec.update((field, t) for t in set(ts))
    want = {(f, t): (occ[f, t], n, "rare" if n <= 2 else "common" if n > filled[f] * 0.1 else None) for (f, t), n in rec.items()}
    df = term_counts.term_frequencies(records(rows, extra=True).repartition(5))
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in df.collect()}
    assert got == want and df.count() == len(want)


@pytest.mark.parametrize("routes,limit", [(512, 50), (4, 20)])
def test_long_common_prefix(spark, records, routes, limit, monkeypatch):
    """Thousands of terms behind one long prefix: no merged subtree is large, and the counts are right."""
    monkeypatch.setattr(term_counts, "ROUTES", routes)
    monkeypatch.setattr(term_counts, "SUBTREE", limit)
    rows = [(i, "c", "d", {"text": " ".join(f"https://www.example.org/{j % 900}" for j in range(i * 30, i * 30 + 45))}, {}) for i in range(60)]
    want = Counter(t for _, _, _, f, _ in rows for t in f["text"].split())
    got = {r["term"]: r["occurrences"] for r in term_counts.term_frequencies(records(rows).repartition(3)).collect()}
    assert got == want
    import pyarrow as pa

    leaf = next(term_counts._rows("text", iter([("https://www.", {f"e{i}": (1, 1) for i in range(900)})])))
    deep = {"text": {"https://www."[:i]: 900 for i in range(13)}}
    cut = pa.Table.from_batches(list(term_counts._route(iter([leaf]), deep, {"text": 900}, limit, routes))).to_pylist()
    assert max(len(r["terms"]) for r in cut) < 3 * limit and sum(len(r["terms"]) for r in cut) == 900


def test_signs():
    assert term_counts.signs("\U00013000<g>Ff1</g>x\U00013000<g></g>") == ["\U00013000", "Ff1", "\U00013000"]


def test_terms_of_awkward_tables(records, awkward):
    r = {(x["field"], x["term"]): x for x in term_counts.term_frequencies(awkward).collect()}
    assert r["text", "wort"]["records"] == 3 and r["text", "wort"]["occurrences"] == 120_000
    assert term_counts.term_frequencies(records([])).count() == 0
