import json

from pyspark.sql import functions as F

from lapidary import cli
from lapidary.functions import arrays as A
from lapidary.operators import ledger as L
from lapidary.operators import splits as S
from lapidary.plans.smoke import run_smoke, toy_corpus


def test_toy_corpus(spark):
    a, key = toy_corpus(spark)
    b, _ = toy_corpus(spark)
    assert a.count() == 240 and a.exceptAll(b).count() == 0 and a.select("doc_id").distinct().count() == 30
    src, tgt = a.select("src", "tgt").first()
    assert "".join(key.get(c, c) for c in src) == tgt and len(set(key.values())) == 12
    assert toy_corpus(spark, seed=2)[1] != key


def test_smoke_twice(spark, tmp_path):
    one, two = run_smoke(spark, str(tmp_path)), run_smoke(spark, str(tmp_path))
    assert one["key_accuracy"] >= 0.5 and {k: v for k, v in one.items() if k != "run_id"} == {k: v for k, v in two.items() if k != "run_id"}
    runs = L.Ledger(spark, str(tmp_path / "ledger")).runs()
    assert {r["n_variants_tried_so_far_in_this_family"]: r["status"] for r in runs.collect()} == {1: "completed", 2: "completed"}


def test_commands(spark, tmp_path, capsys):
    raw, root = tmp_path / "raw", str(tmp_path / "root")
    raw.mkdir()
    for b in range(12):
        verses = "".join(f'<verse osisID="B{b:02d}.{i}"><w>א{i}</w><w>ב{b}</w></verse>' for i in range(5))
        (raw / f"B{b:02d}.xml").write_text(f"<osis>{verses}</osis>")
    run = lambda *a: (cli.main([str(x) for x in a], spark), capsys.readouterr().out)
    code, out = run("ingest", "hebrew_morphhb", raw, root)
    assert code == 0 and json.loads(out)["n_records"] == 60 and json.loads(out)["field_coverage"] == {"text": 60}
    assert run("ingest", "mayan", raw, root)[0] == 1
    assert "| hebrew_morphhb | monolingual | ingested | 60 | 12 | 120 | - |" in run("census", root)[1]
    code, out = run("split", "hebrew_morphhb", "document_heldout", root)
    assert code == 0 and sum(json.loads(out)["sizes"].values()) == 60
    info = json.loads((tmp_path / "root/hebrew_morphhb/splits/document_heldout/v1/_split_info.json").read_text())
    assert info == json.loads(out) and spark.read.parquet(f"{root}/hebrew_morphhb/splits/document_heldout/v1").count() == 60
    assert json.loads((tmp_path / "root/census/census.json").read_text())["hebrew_morphhb"]["n_records"] == 60
    manifest = json.loads((tmp_path / "root/hebrew_morphhb/manifest.json").read_text())
    assert cli.data_versions(spark, root, ["hebrew_morphhb"] * 2) == "+".join([manifest["data_version"]] * 2)
    code, out = run("split", "hebrew_morphhb", "all", root, "--tag", "v2", "--dedup-max-norm-dist", "0")
    assert code == 0 and [json.loads(x)["scheme"] for x in out.splitlines()] == ["random", "document_heldout", "dedup"]
    assert all(r["removed_near"] == 0 for x in out.splitlines() for r in json.loads(x)["report"])
    assert run("ingest", "all", tmp_path / "none", root)[0] == 1
    assert run("freeze", "hebrew_morphhb", "document_heldout", root)[0] == 0 and run("verify", root) == (0, "all frozen parts are intact\n")
    led = L.Ledger(spark, str(tmp_path / "led"))
    assert run("ledger", tmp_path / "led", "list")[1] == "the ledger is empty\n"
    a = led.register("f", "h", 1, selection_metric="acc")
    led.complete(a, metrics={"acc": 0.25})
    assert "best 0.2500" in run("ledger", tmp_path / "led", "report")[1]
    assert run("ledger", tmp_path / "led", "list", "--status", "failed")[1] == "" and a in run("ledger", tmp_path / "led", "list")[1]
    assert run("ledger", tmp_path / "led", "show", a)[0] == 0 and run("ledger", tmp_path / "led", "show", "x")[0] == 1
    assert run("ledger", tmp_path / "led", "compact")[1] == "compacted 2 event(s)\n"


def test_recovery_and_gates(spark, tmp_path, capsys):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "slurm-7.out").write_text("[train] 9 params -> runs/20260105-003157-12d687\n[train] done: 20 steps, loss 2.5 -> 1.0, best_eval=0.5\n")
    (tmp_path / "runs" / "20260105-003157-12d687").mkdir(parents=True)
    (tmp_path / "runs" / "20260105-003157-12d687" / "config.yaml").write_text("family: f\nhypothesis: h\nseed: 3\n")
    run = lambda *a: (cli.main([str(x) for x in a], spark), capsys.readouterr().out)
    args = ("recover", tmp_path / "logs", tmp_path / "runs", tmp_path / "led")
    assert run(*args) == (0, "20260105-003157-12d687\n") and run(*args, "--apply")[0] == 0 and run(*args) == (0, "no run is missing\n")
    r = L.Ledger(spark, str(tmp_path / "led")).runs().first()
    assert (r["family"], r["seed"], r["status"]) == ("f", 3, "completed")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = Auto" + "Model\n")
    assert run("gate", "sources", tmp_path / "src")[0] == 1 and run("gate", "sources", tmp_path / "src", "--pattern", "zzz") == (0, "clean\n")


def test_reconstruct(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path))
    logs = spark.createDataFrame([("20260105-003157-12d687", "7", 10, float("inf"))], "run_id string, job string, steps long, best_eval double")
    cfg = spark.createDataFrame([("20260105-003157-12d687", "f", 3)], "run_id string, family string, seed long")
    assert L.reconstruct(led, logs, cfg) == ["20260105-003157-12d687"] and not led._has()
    L.reconstruct(led, logs, cfg, apply=True)
    r = led.runs().withColumn("v", L.metric("all_metrics", "selection_metric")).first()
    assert r["status"] == "completed" and r["v"] == float("inf") and r["registered_at"] == "2026-01-05T00:31:57+00:00"
    assert L.reconstruct(led, logs, cfg) == []


def test_schemes(spark, records):
    r = records([(i, "c", f"d{i // 5}", {"t": f"text number {i * 7919} of all", "hieroglyphs": chr(0x13000 + i % 60)}, {"dateNotBefore": str(-2000 + 100 * (i % 12)), "period": f"p{i % 9}"}) for i in range(400)])
    meta = {"kind": "monolingual", "primary_field": "t", "translation_field": None}
    for scheme in ("random", "document_heldout", "dedup", "period_heldout", "sign_heldout"):
        out, _ = S.apply_scheme(scheme, r, meta)
        assert {x[0] for x in out.select("part").distinct().collect()} == {"train", "valid", "test"} and out.count() <= 400


def test_masks_and_glyphs(spark):
    for n in (1, 2, 9, 40):
        for span in (1, 4):
            m = A.window_mask(n, 0.5, 3, span)
            assert m == A.window_mask(n, 0.5, 3, span) and m == sorted(set(m)) and m and (n == 1 or len(m) < n)
    assert (A.glyph("a") == A.glyph("a")).all() and (A.glyph("a") != A.glyph("b")).any() and A.glyph_strip([]).min() == 1
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (None,)], "s array<string>")
    assert [r[0] for r in A.rendered(df, "s").select(F.size(F.get("strip", F.lit(0)))).collect()][:2] == [72, 24]


def test_strips_leave_in_small_batches(spark, monkeypatch):
    """However many rows come at once; a strip above the limit goes alone.  What is measured in the worker equals what is measured of the strip."""
    import pyarrow as pa

    lists = [["a", "b"], [], None, ["c"] * 30, ["d"], ["e", "f", "g"]] * 200
    b = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["i", "s"])
    monkeypatch.setattr(A, "CELLS", 10 * 24 * 24)
    out = list(A._drawn(iter([b]), 1, [0, 1], ["i", "s", "strip"]))
    assert [x for o in out for x in o.column(0).to_pylist()] == list(range(len(lists)))
    assert all(o.num_rows == 1 or len(o.column(2).flatten().flatten()) <= 10 * 24 * 24 for o in out)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists[:6])], "i int, s array<string>")
    drawn = A.rendered(df, "s").select("i", F.size(F.get("strip", F.lit(0))).alias("width"), A.ink_fraction(F.col("strip")).alias("ink"))
    want = {r["i"]: (r["width"], r["ink"]) for r in drawn.collect() if r["i"] != 2}
    got = {r["i"]: (r["width"], r["ink"]) for r in A.rendered_facts(df, "s").collect()}
    assert got.pop(2) == (None, None) and got == want and len(want) == 5
    monkeypatch.setattr(A, "SIGNS", 7)
    assert A._facts(lists[3]) == want[3]
