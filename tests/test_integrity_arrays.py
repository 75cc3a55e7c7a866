import hashlib
import math
import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapidary.functions import arrays as A
from lapidary.functions.hashing import config_hash, content_hash, derive_seed
from lapidary.functions.text import is_test_path, run_timestamp
from lapidary.operators import splits as S
from lapidary.operators.integrity import FrozenError, Store, current_run, inside_test, run_context


def test_store(spark, records, tmp_path):
    r = records([(i, "c", f"d{i // 5}", {"text": f"t{i}", "z": None}, {}) for i in range(100)])
    store = Store(spark, str(tmp_path))
    store.write(S.split_document(r), "c", "document_heldout")
    h = store.freeze("c", "document_heldout")
    assert store.freeze("c", "document_heldout") == h and store.verify() == []
    with pytest.raises(FrozenError):
        store.write(S.split_document(r, seed=2), "c", "document_heldout")
    assert store.read("c", "document_heldout").count() > 0 and store.audit().count() == 0
    with run_context("r1"):
        n = store.read("c", "document_heldout", part="test").count()
    store.read("c", "document_heldout", part="test")
    assert n > 0 and current_run() is None
    assert sorted((x["run_id"] or "", "test_integrity" in x["caller"]) for x in store.audit().collect()) == [("", True), ("r1", True)]
    one = next(Path(store.path("c", "document_heldout", "v1")).glob("part=test/*.parquet"))
    shutil.copy(one, one.with_name("again.parquet"))
    assert store.verify() == ["changed c/document_heldout/v1/test"]
    for f in (lambda: store.read("c", "document_heldout", part="test"), lambda: store.freeze("c", "document_heldout")):
        with pytest.raises(FrozenError):
            f()
    shutil.rmtree(store.path("c", "document_heldout", "v1"))
    assert store.verify() == ["missing c/document_heldout/v1/test"]


def test_hashes(spark, records):
    r = records([(i, "c", None, {"a": "1", "b": None}, {}) for i in range(20)])
    assert content_hash(r) == content_hash(r.repartition(7)) != content_hash(r.where("ord > 0"))
    assert content_hash(r) != content_hash(r.unionByName(r))
    assert config_hash({"b": 1, "a": "ä"}) == hashlib.sha256('{"a":"ä","b":1}'.encode()).hexdigest()[:12]
    assert derive_seed(1, "x") == int.from_bytes(hashlib.sha256(b"1|x").digest()[:4], "big") % (2**31 - 1)


def test_paths(spark):
    cases = {"/r/data/c/splits/s/v1/test/records.jsonl": True, "/r/data/c/test.jsonl": True, "/r/data/c/train/x": False, "/r/other/test/x": False, "/r/data/latest/x": False, "/r/data": False}
    for p, want in cases.items():
        assert inside_test(p) == want
    assert inside_test("/root/x/test/y", "/root/x") and not inside_test("/root/x/train/y", "/root/x")
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", is_test_path("p")).collect()} == cases
    d = spark.createDataFrame([("20260105-003157-12d687",), ("x",), (None,)], "r string").select(F.date_format(run_timestamp("r"), "yyyy-MM-dd HH:mm:ss"))
    assert [r[0] for r in d.collect()] == ["2026-01-05 00:31:57", None, None]


def strip(spark, a):
    return spark.createDataFrame([([[float(x) for x in r] for r in a],)], "s array<array<float>>")


def test_windows_and_trim(spark):
    for width, n in ((100, 8), (30, 2), (10, 1), (10_000, 512)):
        a = np.zeros((2, width))
        w = np.array(strip(spark, a).select(A.strip_windows(F.col("s"))).first()[0])
        assert w.shape == (n, 2, 24)
        if width == 30:
            assert (w[1, :, 18:] == 1).all() and (w[1, :, :18] == 0).all()
    ink = np.ones((16, 400))
    ink[4:9, 10:210] = 0
    t = np.array(strip(spark, ink).select(A.trim_to_ink(F.col("s"))).first()[0])
    assert t.shape == (9, 204) and np.array(strip(spark, np.ones((3, 5))).select(A.trim_to_ink(F.col("s"))).first()[0]).shape == (3, 5)
    assert abs(strip(spark, ink).select(A.ink_fraction(F.col("s"))).first()[0] - 1000 / 6400) < 1e-12


def test_rows(spark):
    x = [1.0, 2.0, 4.0, 8.0]
    df = spark.createDataFrame([(x,)], "x array<double>")
    assert np.allclose(df.select(A.moving_average(F.col("x"), 3)).first()[0], [4 / 3, 7 / 3, 14 / 3, 20 / 3])
    assert np.allclose(df.select(A.standardise(F.col("x"))).first()[0], (np.array(x) - 3.75) / (np.std(x, ddof=1) + 1e-6))
    lr = spark.range(4).select(A.learning_rate(F.col("id"), 1.0, 2)).collect()
    assert np.allclose([r[0] for r in lr], [0.5, 1.0, math.sqrt(2 / 3), math.sqrt(0.5)])


def test_damage(spark):
    img = np.ones((12, 40), np.float32)
    img[3:8, 5:30] = 0
    assert (A.damage(img, 1, 0) == img).all()
    a, b = A.damage(img, 1, 0.7), A.damage(img, 1, 0.7)
    assert (a == b).all() and a.shape == img.shape and a.min() >= 0 and a.max() <= 1 and (a != A.damage(img, 2, 0.7)).any()
    for name in A.DAMAGE:
        assert A.damage(img, 3, 1.0, (name,)).shape == img.shape
    assert abs(A.blob_mask((40, 40), np.random.default_rng(0), 0.25).mean() - 0.25) < 0.05
    assert np.allclose(A.box_blur(np.arange(9, dtype=np.float32).reshape(1, 9), 3)[0, 1:-1], np.arange(1, 8))
    df = spark.createDataFrame([(i, img.tolist() if i else None) for i in range(4)], "k long, s array<array<float>>")
    one, two = ({r["k"]: r["s"] for r in A.damaged(df.repartition(n), "s", "k", 7, 0.5).collect()} for n in (1, 3))
    assert one == two and one[0] is None and one[1] != one[2]
    for mode in ("single", "span", "damage"):
        for n in (1, 7, 40):
            m = A.mask_plan(n, mode, 5)
            assert m == A.mask_plan(n, mode, 5) and m == sorted(set(m)) and 0 <= m[0] and m[-1] < n
    assert len(A.mask_plan(40, "damage", 1)) == 10 and len(A.mask_plan(9, "single", 1)) == 1
    with pytest.raises(ValueError):
        A.mask_plan(0, "single", 1)
