import json
from dataclasses import dataclass

import pytest

from lapidary.sources import config, corpora, logs
from lapidary.sources.base import NotIngestable
from lapidary.sources.records import data_version, read_jsonl, write_jsonl
from lapidary.sources.registry import CORPORA, registry_table


def put(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


def rows(df):
    return [r.asDict() for r in df.orderBy("ord").collect()]


def test_jsonl(spark, records, tmp_path):
    r = records([(0, "c", "d", {"text": "ⲁⲃ \U00013000 \"q\" \\ \n", "x": None}, {}), (1, "c", None, {}, {"k": "v"})])
    assert write_jsonl(r, str(tmp_path / "o")) == 2
    back = read_jsonl(spark, str(tmp_path / "o"))
    assert [(x["fields"], x["meta"], x["doc_id"]) for x in rows(back)] == [(x["fields"], x["meta"], x["doc_id"]) for x in rows(r)]
    assert data_version(r) == data_version(back.repartition(3))
    put(tmp_path, "m/x.jsonl", '{"corpus":"c","doc_id":"d","sent_id":"s","fields":{"t":"v"}}\n\n  \n')
    assert rows(read_jsonl(spark, str(tmp_path / "m")))[0]["meta"] == {}
    put(tmp_path, "bad/x.jsonl", "{oops\n")
    with pytest.raises(Exception):
        read_jsonl(spark, str(tmp_path / "bad")).collect()


def test_conllu(spark, tmp_path):
    put(tmp_path, "bohairic.x/a.conllu", "# newdoc id = D1\n# text = lost\n# sent_id = s1\n# text = ⲁ ⲃ\n# text_en = hello\n1\tx\n\n# text = ⲅ\n1\ty")
    put(tmp_path, "other/b.conllu", "# sent_id = s3\n# text = ⲇ\n\n\n")
    r = rows(corpora.read_conllu(spark, str(tmp_path)))
    assert [x["sent_id"] for x in r] == ["s1", "coptic_scriptorium-s0000001", "s3"]
    assert r[0]["fields"] == {"text": "ⲁ ⲃ", "translation_en": "hello"} and r[1]["fields"] == {"text": "ⲅ"}
    assert [x["meta"]["dialect"] for x in r] == ["bohairic", "bohairic", "sahidic"] and [x["doc_id"] for x in r] == ["D1", "D1", "other/b"]


def test_osis(spark, tmp_path):
    x = '<osis xmlns="http://www.bibletechnologies.net/2003/OSIS/namespace"><div><verse osisID="Gen.1.1"><w> בְּ </w><w>רֵא</w></verse><verse osisID="Gen.1.2"><w>א</w></verse><verse osisID="Gen.1.3"/></div></osis>'
    put(tmp_path, "Gen.xml", x)
    put(tmp_path, "VerseMap.xml", x)
    r = rows(corpora.read_osis(spark, str(tmp_path)))
    assert [(y["doc_id"], y["sent_id"]) for y in r] == [("Gen", "Gen.1.1"), ("Gen", "Gen.1.2")] and r[0]["fields"]["text"] == "בְּ רֵא"


def test_tei(spark, tmp_path):
    t = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><p>ἐν ἀρχῇ  ἦν\n<l>ὁ λόγος καὶ θεός</l></p><p>δύο λόγοι</p><p>only latin words here</p></body></text></TEI>'
    put(tmp_path, "tlg1/tlg2/a.grc1.xml", t)
    put(tmp_path, "tlg1/tlg2/a.eng1.xml", t)
    r = rows(corpora.read_tei(spark, str(tmp_path)))
    assert [y["sent_id"] for y in r] == ["tlg1.tlg2.a.grc1.00000", "tlg1.tlg2.a.grc1.00001"]
    assert r[0]["fields"]["text"] == "ἐν ἀρχῇ ἦν ὁ λόγος καὶ θεός" and r[0]["doc_id"] == "tlg1.tlg2"
    put(tmp_path, "tlg1/tlg2/b.grc1.xml", "<TEI>")
    with pytest.raises(NotIngestable, match="malformed"):
        corpora.read_tei(spark, str(tmp_path))
    with pytest.raises(NotIngestable):
        corpora.read_tei(spark, str(tmp_path / "none"))


def test_atf_and_catalogue(spark, tmp_path):
    a = put(tmp_path, "atf/x.atf", b"junk 1. x\n&P000001 = AAS 1\n#atf: lang\n@tablet\n1. a-na\n$ ruling\n2'. szar \xff\n3. \n&P000002 = B\n@obverse\n&P000003 = C\n1. x\n")
    c = put(tmp_path, "cat/cat.csv", "id_text,language,period\n1,Sumerian,Ur III\n,x,y\n1,Akkadian,\n3,,Late\n")
    r = rows(corpora.read_cdli(spark, a, c))
    assert [y["sent_id"] for y in r] == ["P000001", "P000003"]
    assert r[0]["fields"]["text"].startswith("a-na / szar") and r[0]["meta"] == {"designation": "AAS 1", "language": "Akkadian"}
    assert r[1]["meta"] == {"designation": "C", "period": "Late"}
    with pytest.raises(NotIngestable, match="tablet id"):
        corpora.read_catalogue(spark, put(tmp_path, "cat/bad.csv", "x,y\n1,2\n"))


def test_tables_and_lines(spark, tmp_path):
    r = rows(corpora.read_cognates(spark, put(tmp_path, "a/x.cog", "uga\theb\nab\tcd\n\nef\tgh|ij\n"), "cog", "u", "h"))
    assert [(y["sent_id"], y["fields"]) for y in r] == [("cog-p00000", {"src": "ab", "tgt": "cd"}), ("cog-p00002", {"src": "ef", "tgt": "gh|ij"})]
    for bad in ("uga\nx\n", "a\tb\nx\ty\tz\n"):
        with pytest.raises(Exception, match="2-column"):
            corpora.read_cognates(spark, put(tmp_path, f"b{len(bad)}/x.cog", bad), "cog", "u", "h").collect()
    for f in corpora.LINE_FILES.values():
        put(tmp_path, f"m/{f}", " one \n\n \ntwo\n")
    r = rows(corpora.read_lines(spark, str(tmp_path / "m")))
    assert len(r) == 8 and [y["sent_id"] for y in r[:2]] == ["mero-corpus.00000", "mero-corpus.00001"] and r[0]["fields"] == {"text": "one"} and r[-1]["doc_id"] == "tanyidamani"


def test_images_and_inventory(spark, tmp_path):
    entries = [{"tl": "a", "ta": "b", "image": "x/1.png", "date": "D2"}, {"tl": "a", "ta": "", "image": "2.png"}, {"tl": "a", "ta": "b", "image": "3.png"}, {"tl": " c ", "ta": "d", "image": "4.png"}]
    put(tmp_path, "EGY/metadata/metadata.json", json.dumps(entries))
    for i in (1, 4):
        put(tmp_path, f"EGY/metadata/textline/{i}.png", b"0123456789")
    r, missing = corpora.read_image_entries(spark, str(tmp_path / "EGY"))
    r = rows(r)
    assert [(y["doc_id"], y["sent_id"]) for y in r] == [("logogram_egy-d001", "logogram_egy-s00000"), ("logogram_egy-d002", "logogram_egy-s00003")]
    assert r[1]["fields"]["transliteration"] == "c" and r[1]["meta"] == {"date": "unknown"} and missing.first()[0] == 1
    put(tmp_path, "inv/s/.DS_Store", b"zz")
    put(tmp_path, "inv/s/deep/a.PNG", b"0123456789")
    put(tmp_path, "inv/u/b.json", b"{}")
    h = {x["subset"]: x for x in corpora.read_inventory(spark, str(tmp_path / "inv")).collect()}
    assert (h["s"]["files"], h["s"]["bytes"], h["s"]["by_extension"]) == (1, 10, {".png": 1}) and h["u"]["files"] == 1


def test_hosted(spark):
    df = spark.createDataFrame([(0, "t", "l", "u", "g", "de", None), (1, "t", "l", "u", "g", "de", "-100"), (2, "t", "l", "u", "g", "de", None)], "i long, transliteration string, lemmatization string, UPOS string, glossing string, translation string, dateNotBefore string")
    r = rows(corpora.read_hosted(df, "c"))
    assert [y["doc_id"] for y in r] == ["c-d00001", "c-d00002", "c-d00001"] and r[0]["meta"] == {"dateNotBefore": None, "dateNotAfter": None} and "hieroglyphs" not in r[0]["fields"]


def test_registry(spark, tmp_path):
    t = registry_table(spark)
    assert t.count() == 15 and t.where("kind = 'stub'").count() == 3
    with pytest.raises(NotIngestable):
        CORPORA["mayan"].records(spark, str(tmp_path))
    with pytest.raises(NotIngestable, match="fetch"):
        CORPORA["hebrew_morphhb"].records(spark, str(tmp_path / "absent"))


def test_logs_gates_reports(spark, tmp_path):
    put(tmp_path, "l/slurm-1.out", "[train] 1,234 params -> runs/r1\nx\n[train] done: 10 steps, loss 2.5 -> 1.5, best_eval=inf\n")
    put(tmp_path, "l/slurm-2.out", "[train] 9 params -> runs/r1\n[train] done: 20 steps, loss 2.5 -> 1.0, best_eval=0.5\n")
    put(tmp_path, "l/slurm-3.out", "[train] 9 params -> runs/r2\n")
    r = logs.read_logs(spark, str(tmp_path / "l")).collect()
    assert [(x["run_id"], x["job"], x["steps"], x["best_eval"], x["params"]) for x in r] == [("r1", "2", 20, 0.5, 9)]
    put(tmp_path, "s/a.py", "import os\nfrom_pretrained('x')\n")
    put(tmp_path, "s/ok/b.py", "from_pretrained('x')\n")
    assert [x["file"] for x in logs.forbidden_lines(spark, str(tmp_path / "s"), r"from_pretrained\(", exclude="ok/").collect()] == ["a.py"]
    put(tmp_path, "r/x.tex", "\\documentclass{a}")
    put(tmp_path, "r/part.tex", "no main file")
    put(tmp_path, "r/y.tex", "\\documentclass{a} \\newcommand{\\ReportStamp}{v1}")
    put(tmp_path, "r/z.tex", "\\documentclass{a}")
    for f in "yz":
        put(tmp_path, f"r/{f}.pdf", "v1")
    assert sorted(x["why"] for x in logs.stale_reports(spark, str(tmp_path / "r")).collect()) == ["missing", "no stamp"]


def test_config(tmp_path):
    @dataclass
    class Cfg:
        a: int = 1
        b: dict | None = None

    got = config.merged(config.load_yaml(put(tmp_path, "a.yaml", "a: 1\nb: {x: 1, y: 2}\n")), {"b": {"y": 3}})
    assert config.build(Cfg, got) == Cfg(1, {"x": 1, "y": 3})
    with pytest.raises(ValueError, match="unknown"):
        config.build(Cfg, {"z": 1})
    with pytest.raises(ValueError, match="mapping"):
        config.load_yaml(put(tmp_path, "b.yaml", "- 1\n"))
    assert config.check_seeds([1, 2, 3]) == [1, 2, 3]
    for bad in ([1, 2], [1, 1, 2], [1, 2, True]):
        with pytest.raises(ValueError):
            config.check_seeds(bad)
