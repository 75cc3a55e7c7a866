import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lapidary.operators import census as C
from lapidary.operators import evaluation as E
from lapidary.operators import language as G


def texts(spark, *ts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "ord long, text string")


def test_entropies(spark):
    ce = G.unigram_entropy(texts(spark, "abcd" * 500), texts(spark, "abcd" * 10)).first()[0]
    assert abs(ce - math.log(4)) < 0.02
    t = texts(spark, "ab" * 200)
    assert G.bigram_entropy(t, t).first()[0] < G.unigram_entropy(t, t).first()[0]
    assert math.isfinite(G.unigram_entropy(texts(spark, "aaaa"), texts(spark, "zzzz")).first()[0])
    assert math.isfinite(G.bigram_entropy(texts(spark, "aaaa"), texts(spark, "zzzz")).first()[0])
    with pytest.raises(Exception, match="empty"):
        G.unigram_entropy(t, texts(spark, "", None)).collect()
    with pytest.raises(Exception, match="empty"):
        G.bigram_entropy(t, texts(spark, "")).collect()


def test_bigram_against_plain_python(spark):
    rng = random.Random(3)
    tr, ev = ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 30))) for _ in range(20)], ["".join(rng.choice("abcde ") for _ in range(12)) for _ in range(5)]
    seen, ctx = {}, {}
    for t in tr:
        for a, b in zip("\x02" + t, t):
            seen[a, b] = seen.get((a, b), 0) + 1
            ctx[a] = ctx.get(a, 0) + 1
    v = len({b for _, b in seen})
    p = [(seen.get((a, b), 0) + 0.5) / (ctx[a] + 0.5 * (v + 1)) if a in ctx else 1 / (v + 1) for t in ev for a, b in zip("\x02" + t, t)]
    assert abs(G.bigram_entropy(texts(spark, *tr), texts(spark, *ev)).first()[0] + sum(map(math.log, p)) / len(p)) < 1e-9


def test_frequencies_and_ranks(spark):
    f = G.char_frequencies(texts(spark, "aab", "b c"), list("abc"))
    assert {r["ch"]: round(r["freq"], 6) for r in f.collect()} == {"a": 0.4, "b": 0.4, "c": 0.2}
    with pytest.raises(Exception, match="alphabet"):
        G.char_frequencies(texts(spark, "xyz"), list("abc")).collect()
    df = lambda cs, fs: spark.createDataFrame([(c, i, f) for i, (c, f) in enumerate(zip(cs, fs))], "ch string, pos int, freq double")
    m = G.rank_match(df("abc", [0.1, 0.7, 0.2]), df("ABC", [0.7, 0.1, 0.2]))
    assert {r[0]: r[1] for r in m.collect()} == {"b": "A", "c": "C", "a": "B"}
    key = spark.createDataFrame([("a", "B"), ("b", "A"), ("c", "X")], "src string, tgt string")
    assert abs(G.key_accuracy(m, key).first()[0] - 2 / 3) < 1e-12
    with pytest.raises(Exception, match="inventories"):
        G.key_accuracy(m, key.where("src <> 'a'")).collect()
    p = spark.createDataFrame([("a b", "a c"), ("x", "x")], "h string, r string")
    assert abs(G.token_accuracy(p, "h", "r").first()[0] - 2 / 3) < 1e-12
    with pytest.raises(Exception, match="word counts"):
        G.token_accuracy(spark.createDataFrame([("a b", "a")], "h string, r string"), "h", "r").collect()


def test_vocabulary_ties_by_first_appearance(spark):
    v = G.char_vocabulary(texts(spark, "ba", "abc", "", None), size=3)
    assert {r[0]: r[1] for r in v.collect()} == {"b": 4, "a": 5, "c": 6}


def slots(spark, rows):
    return spark.createDataFrame(rows, "labels array<string>, probs array<double>, truth string")


def test_bins_recall_calibration(spark):
    b = {r[0]: r[1] for r in E.frequency_bins(spark.createDataFrame([("A", 100), ("B", 50), ("C", 2)], "sign string, c long")).collect()}
    assert b == {"A": "frequent", "B": "medium", "C": "rare"}
    four = [r[1] for r in E.frequency_bins(spark.createDataFrame([(x, 9 - i) for i, x in enumerate("abcd")], "sign string, c long")).collect()]
    assert [four.count(x) for x in ("frequent", "medium", "rare")] == [1, 1, 2]
    s = slots(spark, [(["A", "B"], [0.5, 0.5], "A"), (["B", "A"], [0.5, 0.5], "B"), (["A", "B", "C"], [0.4, 0.3, 0.3], "C")])
    bins = spark.createDataFrame(list(b.items()), "sign string, bin string")
    r = {x["bin"]: x for x in E.recall_at(s, bins, (1, 3)).collect()}
    assert abs(r[None]["recall_1"] - 2 / 3) < 1e-12 and r[None]["recall_3"] == 1 and r["rare"]["recall_1"] == 0 and r["rare"]["recall_3"] == 1
    one = lambda ok: spark.createDataFrame([(1.0, ok)] * 5, "conf double, correct boolean")
    assert E.calibration_error(one(True)).first()[0] == 0 and E.calibration_error(one(False)).first()[0] == 1


def test_conformal(spark):
    n100 = slots(spark, [(["a", "b"], [i / 100, 1 - i / 100], "a") for i in range(100)])
    assert abs(E.conformal_threshold(n100, 0.9).first()[0] - 0.91) < 1e-12  # place 91 from 0
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        p = [rng.gammavariate(1, 1) for _ in range(5)]
        p = sorted((x / sum(p) for x in p), reverse=True)
        rows.append((list("abcde"), p, rng.choices("abcde", p)[0]))
    cal, ev = slots(spark, rows[:300]), slots(spark, rows[300:])
    sizes = []
    for target in (0.7, 0.9):
        s = E.conformal_sets(ev, E.conformal_threshold(cal, target)).first()
        assert s["coverage"] >= target - 0.05
        sizes.append(s["mean_size"])
    assert sizes[1] > sizes[0]
    assert E.conformal_threshold(slots(spark, [(["a"], [0.3], "z")] * 3), 0.5).first()[0] == 1.0
    with pytest.raises(ValueError):
        E.conformal_threshold(cal, 1.0)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.floats(0.1, 0.9))
def test_threshold_against_plain_python(spark, places, target):
    rows = [(list("abcd"), [0.4, 0.3, 0.2, 0.1], "abcd"[p]) for p in places]
    scores, n = sorted(sum([0.4, 0.3, 0.2, 0.1][: p + 1]) for p in places), len(places)
    k = math.ceil((n + 1) * target)
    want = scores[min(math.ceil(min(1.0, k / n) * (n - 1)), n - 1)]
    assert abs(E.conformal_threshold(slots(spark, rows), target).first()[0] - want) < 1e-9


def test_bootstrap(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(f"d{i // 10}", 5 + rng.gauss(0, 1) + i // 10 % 3, 0.0) for i in range(200)], "doc_id string, v double, w double")
    a, b = E.block_bootstrap(df, "v", n_boot=100).first(), E.block_bootstrap(df.repartition(5), "v", n_boot=100).first()
    assert a["low"] < a["point"] < a["high"] and abs(a["low"] - b["low"]) < 1e-9
    with pytest.raises(Exception, match="2 documents"):
        E.block_bootstrap(df.where("doc_id = 'd1'"), "v", n_boot=5).collect()
    p = E.paired_bootstrap(df.selectExpr("doc_id", "v", "v - 2 as u"), "v", "u", n_boot=100).first()
    assert abs(p["delta"] - 2) < 1e-9 and p["significant"] and p["p_value"] == 0
    z = E.paired_bootstrap(df, "v", "v", n_boot=50).first()
    assert z["delta"] == 0 and z["p_value"] == 1 and not z["significant"]


def test_translation_scores(spark):
    p = spark.createDataFrame([(0, "the cat sat on the mat today", "the cat sat on the mat today"), (1, "a b c d e", "a b c d e")], "id long, hyp string, ref string")
    assert abs(E.corpus_chrf(p).first()[0] - 100) < 1e-9 and abs(E.corpus_bleu(p).first()[0] - 100) < 1e-9
    q = spark.createDataFrame([(0, "xyz", "abc"), (1, None, "abc"), (2, "abcd", "abce")], "id long, hyp string, ref string")
    s = {r[0]: r[1] for r in E.sentence_chrf(q).collect()}
    assert s[0] == 0 and s[1] == 0 and 0 < s[2] < 100
    # orders 1..4: matches 3/4, 2/3, 1/2, 0/1 on both sides
    assert abs(s[2] - 100 * (3 / 4 + 2 / 3 + 1 / 2) / 4) < 1e-9
    b = E.corpus_bleu(spark.createDataFrame([(0, "the cat is here", "the cat is there now")], "id long, hyp string, ref string")).first()[0]
    assert abs(b - 100 * math.exp((math.log(3 / 4) + math.log(2 / 3) + math.log(1 / 2) + math.log(1 / 2)) / 4 + 1 - 5 / 4)) < 1e-9


def test_census(spark, records):
    r = records([(0, "a", "d", {"text": "x y", "t": None}, {}), (1, "a", None, {"text": None}, {}), (2, "b", "d", {}, {})])
    c = spark.createDataFrame([("a", "monolingual", "text"), ("b", "parallel", "text"), ("s", "stub", None), ("p", "monolingual", "text")], "corpus string, kind string, primary_field string")
    s = C.ingest_stats(r, c)
    assert {x["corpus"]: (x["n_records"], x["n_docs"], x["n_tokens_primary"]) for x in s.collect()} == {"a": (2, 2, 2), "b": (1, 1, 0)}
    t = C.census(c, s)
    assert {x["corpus"]: x["status"] for x in t.collect()} == {"a": "ingested", "b": "ingested", "s": "stub", "p": "pending"}
    assert "| a | monolingual | ingested | 2 | 2 | 2 | - |" in C.census_markdown(t)
    assert {x[0]: x[1] for x in C.coverage_map(r).collect()}["a"] == {"text": 2, "t": 1}
    f = spark.createDataFrame([("s", "s/a.PNG", 10), ("s", "s/.DS_Store", 5), ("s", "s/b", 1), ("u", "u/x.json", 3)], "subset string, path string, length long")
    h = {x["subset"]: x for x in C.extension_histogram(f).collect()}
    assert h["s"]["files"] == 2 and h["s"]["bytes"] == 11 and h["s"]["by_extension"] == {".png": 1, "<none>": 1}
