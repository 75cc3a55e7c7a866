import pytest
from pyspark.sql import functions as F

from lapidary.functions.text import encipher, extract_signs, normalize_py, period_bucket, prepare_text, token_count
from lapidary.operators import dedup as D
from lapidary.operators import keys as K
from lapidary.operators import splits as S


def docs(records, n_docs=30, per=10):
    return records([(i, "c", f"d{i // per:03d}", {"text": f"text {i}"}, {}) for i in range(n_docs * per)])


def parts(df, key="doc_id"):
    out = {}
    for r in df.select("part", key).collect():
        out.setdefault(r[0], []).append(r[1])
    return out


def test_random_sizes_and_seed(records):
    r = docs(records)
    a, b = parts(S.split_random(r, seed=1), "ord"), parts(S.split_random(r.repartition(7), seed=1), "ord")
    assert {k: len(v) for k, v in a.items()} == {"train": 240, "valid": 30, "test": 30}
    assert set(a["test"]) == set(b["test"])
    assert set(a["test"]) != set(parts(S.split_random(r, seed=2), "ord")["test"])


def test_document_split_is_disjoint(records):
    p = parts(S.split_document(docs(records)))
    assert sum(map(len, p.values())) == 300
    sets = [set(v) for v in p.values()]
    assert len(sets) == 3 and not (sets[0] & sets[1] or sets[0] & sets[2] or sets[1] & sets[2])


def test_group_split_against_plain_python(spark, records):
    import hashlib

    rows = [(i, "c", f"d{i * i % 17}", {}, {}) for i in range(200)]
    weight = {}
    for _, _, d, _, _ in rows:
        weight[d] = weight.get(d, 0) + 1
    want, cum = {}, 0
    for d in sorted(weight, key=lambda d: hashlib.sha256(f"1337|document|{d}".encode()).hexdigest()):
        cum += weight[d]
        want[d] = "train" if cum <= 160 or cum == weight[d] else "valid" if cum <= 180 else "test"
    for n in (1, 7):
        got = {r[0]: r[1] for r in S.split_document(records(rows).repartition(n)).select("doc_id", "part").distinct().collect()}
        assert got == want


def test_errors(records):
    with pytest.raises(S.SplitError, match="sum to 1"):
        S.split_document(docs(records), {"train": 0.9, "valid": 0.2, "test": 0.1})
    with pytest.raises(S.SplitError, match="exactly"):
        S.split_document(docs(records), {"train": 1.0})
    with pytest.raises(S.SplitError, match="empty"):
        S.check_parts(S.split_document(docs(records, 2)))
    with pytest.raises(S.SplitError, match="century buckets"):
        S.split_period(records([(i, "c", "d", {}, {"dateNotBefore": "-1580"}) for i in range(50)]))
    with pytest.raises(S.SplitError, match="no record"):
        S.split_metadata(docs(records), "dialect")
    with pytest.raises(S.SplitError, match="no signs"):
        S.split_sign_heldout(records([(0, "c", "d", {"hieroglyphs": "abc"}, {})]))


def test_period_and_metadata(records):
    r = records([(i, "c", "d", {}, {"dateNotBefore": str(-2000 + 100 * (i % 8))}) for i in range(400)])
    p = S.split_period(r).withColumn("b", period_bucket(F.col("meta")["dateNotBefore"]))
    by = parts(p, "b")
    assert not set(by["train"]) & set(by.get("test", []))
    m = records([(0, "c", "d", {}, {"k": None}), (1, "c", "d", {}, {}), (2, "c", "d", {}, {"k": "v"})])
    assert [r[0] for r in m.orderBy("ord").select(S.metadata_group("k")).collect()] == ["None", "unknown", "v"]


def test_sign_heldout(records):
    signs = [chr(0x13000 + i) for i in range(30)]
    r = records([(i, "c", f"d{i // 8}", {"hieroglyphs": "".join(signs[(i * 7 + j * 11) % 30] for j in range(3))}, {}) for i in range(320)])
    split, held = S.split_sign_heldout(r, n_signs=3, band=(0, 1))
    bad = {h[0] for h in held.collect()}
    for part, text in split.select("part", F.col("fields")["hieroglyphs"]).collect():
        assert bool(bad & set(text)) == (part == "test")


def test_document_count_split_and_version(records):
    p = parts(S.split_by_document_count(docs(records, 40, 3), {"train": 0.7, "valid": 0.15, "test": 0.15}))
    assert {k: len(set(v)) for k, v in p.items()} == {"train": 28, "valid": 6, "test": 6}
    s = S.split_document(docs(records))
    assert S.split_version(s) == S.split_version(s.repartition(5)) and len(S.split_version(s)) == 12


def test_scalar_functions(spark):
    assert normalize_py("  Es werde‚ zerrieben!  ") == "es werde zerrieben"
    assert normalize_py("ΟΔΟΣ") == "οδος" and normalize_py("שָׁלוֹם") == "שלום" and normalize_py("a\x1cb") == "a b" and normalize_py("") == ""
    df = spark.createDataFrame([("\U00013000\U00013001 x <g>Ff101</g>  \U00013000", "-1580"), ("", None), (None, "250"), ("<g></g>", "1_0")], "t string, y string")
    rows = df.select(extract_signs("t"), prepare_text("t"), token_count("t"), period_bucket("y")).collect()
    assert rows[0][0] == ["\U00013000", "\U00013001", "Ff101"] and rows[0][1] == "\U00013000\U00013001 x ▯ \U00013000" and rows[0][2] == 4
    assert [r[3] for r in rows] == ["c-16", "unknown", "c+2", "unknown"]
    assert rows[1][0] == [] and rows[1][2] == 0 and rows[2][2] == 0 and rows[3][1] == "▯"
    e = df.select(encipher(F.lit("BCA B"), {"B": "a", "C": "cc", "A": "b"})).first()[0]
    assert e == "accb a"


def test_keys(records, spark):
    df = spark.createDataFrame([(0, "x"), (1, "x#2"), (2, "x"), (3, "x"), (4, "y"), (5, "y")], "ord long, sent_id string")
    got = {r[0]: r[1] for r in K.unique_ids(df).select("ord", "sent_id").collect()}
    assert got == {0: "x", 1: "x#2", 2: "x#3", 3: "x#4", 4: "y", 5: "y#2"}
    m = records([(0, "c", None, {}, {"dateNotBefore": None}), (1, "c", None, {}, {}), (2, "c", None, {}, {"dateNotBefore": None}), (3, "c", None, {}, {"dateNotBefore": ""})])
    ids = [r[0] for r in K.cohort_ids(m, "c").orderBy("ord").select("doc_id").collect()]
    assert ids == ["c-d00001", "c-d00002", "c-d00001", "c-d00002"]


def test_dedup(records):
    train = [(i, "c", "d", {"t": f"satz nummer {i} mit genug zeichen darin {i * 7919}"}, {}, "train") for i in range(21)]
    other = [
        (30, "c", "d", {"t": "Satz nummer 3 mit genug Zeichen darin 23757!"}, {}, "valid"),
        (31, "c", "d", {"t": "ganz anderes hier steht nun"}, {}, "valid"),
        (32, "c", "d", {"t": "satz nummer 4 mit genug zeichen darim 31676"}, {}, "test"),
        (33, "c", "d", {"t": "noch etwas voellig fremdes"}, {}, "test"),
        (34, "c", "d", {"t": None}, {}, "test"),
    ]
    rows = train + other
    from pyspark.sql import functions as F

    df = records([r[:5] for r in rows])
    part = F.create_map(*[x for r in rows for x in (F.lit(r[0]), F.lit(r[5]))])
    split = df.withColumn("part", part[F.col("ord").cast("int")])
    kept, report = D.dedup_against_train(split, "t")
    got = {r["part"]: (r["checked"], r["removed_exact"], r["removed_near"], r["kept"]) for r in report.collect()}
    assert got == {"valid": (2, 1, 0, 1), "test": (3, 0, 1, 2)}
    assert kept.count() == len(rows) - 2
    exact, rep = D.dedup_against_train(split, "t", 0)
    assert {r["part"]: r["removed_near"] for r in rep.collect()} == {"valid": 0, "test": 0}
    with pytest.raises(KeyError):
        D.dedup_flags(split, "absent")


def test_near_pairs_lose_nothing(spark):
    """Against all pairs, on texts a few edits apart."""
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(8, 90))) for _ in range(40)]

    def edit(t):
        t = list(t)
        for _ in range(rng.randint(0, len(t) // 8)):
            i, how = rng.randrange(max(len(t), 1)), rng.randrange(3)
            t[i : i + (how != 0)] = [] if how == 1 else [rng.choice("abcde")]
        return "".join(t)

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    ev, tr = sorted({edit(b) for b in base for _ in range(2)}), sorted({edit(b) for b in base})
    want = {i for i, a in enumerate(ev) if len(a) >= 10 and any(far(a, b) <= len(a) // 10 for b in tr)}
    e, t = spark.createDataFrame(list(enumerate(ev)), "id long, norm string"), spark.createDataFrame(list(enumerate(tr)), "id long, norm string")
    assert {r[0] for r in D.near_pairs(e, t).collect()} == want and want


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("d", [0.03, 0.25, 0.6])
def test_near_pairs_at_any_distance(spark, d):
    import random

    rng = random.Random(11)
    ev = sorted({"".join(rng.choice("ab ") for _ in range(rng.randint(1, 60))) for _ in range(60)})
    tr = sorted({"".join(c if rng.random() > d * rng.random() * 1.5 else rng.choice(["", "a", "bb"]) for c in x) for x in ev[::2]} - set(ev))
    want = {i for i, a in enumerate(ev) if int(d * len(a)) and any(_distance(a, b) <= int(d * len(a)) for b in tr)}
    e, t = spark.createDataFrame(list(enumerate(ev)), "id long, norm string"), spark.createDataFrame(list(enumerate(tr)), "id long, norm string")
    assert {r[0] for r in D.near_pairs(e, t, d).collect()} == want and 0 < len(want)
    with pytest.raises(ValueError):
        D.near_pairs(e, t, 1.0)


def test_near_pairs_move_texts_not_chunks(spark, monkeypatch):
    """A row a text and length band moves, however long the texts and however alike they are."""
    from lapidary.operators import near_texts as N

    moved, write = [], N.write_blocks

    def counted(*a):
        out = write(*a)
        moved.append((spark.read.parquet(out[0]).count(), out[1].count()))
        return out

    monkeypatch.setattr(N, "write_blocks", counted)
    stock = "".join(chr(97 + i * i % 23) for i in range(400))
    e = spark.createDataFrame([(i, f"{stock} {i:03d} {'x' * 60}") for i in range(40)], "id long, norm string")
    t = spark.createDataFrame([(i, f"{stock} {i:03d} {'y' * 60 if i else 'x' * 60}") for i in range(80)], "id long, norm string")
    assert D.near_pairs(e, t).count() == 40  # 46 edits: the first text is near to each
    assert moved[0][0] == 40 and moved[0][1] <= 3 * 80


def test_dedup_report_reads_one_field(spark, records, tmp_path, monkeypatch):
    """What the query does not compare is left behind before the split; the report is that of the flags."""
    from lapidary.plans import queries as Q

    rows = [(i, "c", f"d{i}", {"translation_de": f"satz nummer {i % 30} mit genug zeichen darin", "text": "x" * 500}, {"dialect": "x"}) for i in range(60)]
    records(rows).write.parquet(f"{tmp_path}/records.parquet")
    seen, split = [], S.split_document
    monkeypatch.setattr(S, "split_document", lambda r: seen.append(r) or split(r))
    report = {r["part"]: r for r in Q.d1_dedup_report(spark, str(tmp_path)).collect()}
    assert seen[0].columns == ["ord", "doc_id", "fields"] and {k for r in seen[0].collect() for k in r["fields"]} == {"translation_de"}
    flags = Q.d1_dedup_flags(spark, str(tmp_path)).where("part <> 'train'").collect()
    assert sum(r["checked"] for r in report.values()) == len(flags) > 0
    assert sum(r["removed_near"] for r in report.values()) == sum(f["removed"] == "near" for f in flags)


def test_empty_tables(records):
    e = records([])
    assert S.split_document(e).count() == 0 and S.split_random(e).count() == 0 and K.cohort_ids(e, "c").count() == 0 and K.unique_ids(e).count() == 0
    assert S.sign_ranks(e).count() == 0
