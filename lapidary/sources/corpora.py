"""Parsers of raw corpora into records."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.operators.keys import cohort_ids, first_seen_number
from lapidary.session import ranked_within, stage
from lapidary.sources.base import NotIngestable, as_records, files, lines, pairs, path_key, require_raw, running_count, whole_files

# -- CoNLL-U sentence headers

_PARSED = "rel string, i int, doc_id string, sent_id string, fields map<string,string>, meta map<string,string>"


_BLANK_LINES = re.compile(r"\n\s*\n")
_HEADER = re.compile(r"^# (newdoc id|sent_id|text_en|text) = (.*)$", re.M)


def _conllu_text(rel: str, text: str) -> Iterator[tuple]:
    """Sentences of a file: blocks between blank lines; headers of a block without text go on into the next."""
    top, name = rel.split("/")[0], rel.rsplit("/", 1)[-1]
    doc = f"{top}/{name.rsplit('.', 1)[0]}"
    meta = {"subcorpus": top, "dialect": "bohairic" if "bohairic" in top.lower() else "sahidic"}
    headers: list[tuple[str, str]] = []
    for block in _BLANK_LINES.split(text):
        headers += [(k, v.strip()) for k, v in _HEADER.findall(block)]
        doc = next((v for k, v in reversed(headers) if k == "newdoc id" and v), doc)
        begins = [i for i, (k, _) in enumerate(headers) if k == "sent_id"]
        own = dict(headers[begins[-1] if begins else 0 :])  # what stands before the last sentence id is lost
        if own.get("text"):
            yield doc, own.get("sent_id"), {k: v for k, v in (("text", own["text"]), ("translation_en", own.get("text_en"))) if v}, meta
            headers = []


def _per_file(parse, df: DataFrame) -> DataFrame:
    """Rows of ``parse(rel, text)`` numbered within their file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(rel, i, *r) for rel, raw in zip(pdf["rel"], pdf["content"]) for i, r in enumerate(parse(rel, bytes(raw)))]
            yield pd.DataFrame(rows, columns=["rel", "i", "doc_id", "sent_id", "fields", "meta"])

    return df.mapInPandas(run, _PARSED)


def read_conllu(spark: SparkSession, root: str, corpus: str = "coptic_scriptorium") -> DataFrame:
    """One record per sentence header; a sentence without id gets its running number over all files."""
    df = whole_files(spark, require_raw(root, f"clone the treebank into {root}"), "*.conllu")
    rows = _per_file(lambda rel, raw: _conllu_text(rel, raw.decode("utf-8")), df).withColumn("pk", path_key(F.col("rel")))
    r = ranked_within(rows, [], ["pk", "i"], "ord").withColumn("sent_id", F.coalesce(F.nullif("sent_id", F.lit("")), F.format_string(f"{corpus}-s%07d", "ord")))
    return r.select(F.lit(corpus).alias("corpus"), "doc_id", "sent_id", "fields", "meta", F.col("ord").cast("long").alias("ord"))


# -- OSIS and TEI


def _osis(rel: str, raw: bytes) -> Iterator[tuple]:
    if rel.rsplit("/", 1)[-1] == "VerseMap.xml":
        return
    for verse in (e for e in ET.fromstring(raw).iter() if e.tag.rsplit("}", 1)[-1] == "verse" and e.get("osisID")):
        texts = [(w.text or "").strip() for w in verse.iter() if w.tag.rsplit("}", 1)[-1] == "w"]
        texts = [t for t in texts if t]
        if texts:
            yield verse.get("osisID").split(".")[0], verse.get("osisID"), {"text": " ".join(texts)}, {}


def read_osis(spark: SparkSession, root: str, corpus: str = "hebrew_morphhb") -> DataFrame:
    """One record per verse with words; the document is the book."""
    rows = _per_file(_osis, whole_files(spark, require_raw(root, f"clone the OSIS files into {root}"), "*.xml"))
    return as_records(rows.withColumn("pk", path_key(F.col("rel"))), corpus, ["pk", "i"])


def _is_greek(text: str) -> bool:
    return any("\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff" for c in text)


def _tei(rel: str, raw: bytes) -> Iterator[tuple]:
    parts, stem = rel.split("/"), rel.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    doc = ".".join(parts[:2]) if len(parts) >= 3 else stem
    body = next((e for e in ET.fromstring(raw).iter() if e.tag.rsplit("}", 1)[-1] == "body"), None)
    n = 0
    for e in body.iter() if body is not None else ():
        if e.tag.rsplit("}", 1)[-1] in ("p", "l"):
            words = unicodedata.normalize("NFC", "".join(x if x.strip() else " " for x in [" ".join(e.itertext())])).split()
            if len(words) >= 3 and _is_greek("".join(words)):
                yield doc, f"{doc}.{stem}.{n:05d}", {"text": " ".join(words)}, {}
                n += 1


def read_tei(spark: SparkSession, root: str, corpus: str = "greek_first1k", tolerance: float = 0.01) -> DataFrame:
    """One record per ``p`` or ``l`` (nested ones too) with three words or more and Greek letters, from files named ``…grc…``.

    Malformed files are left out, up to ``tolerance`` of all; beyond that the read fails.
    """
    df = whole_files(spark, require_raw(root, f"clone the TEI files into {root}"), "*.xml").where(F.element_at(F.split("rel", "/"), -1).contains("grc"))
    bad = "\x00malformed"

    def parse(rel: str, raw: bytes) -> list[tuple]:
        try:
            return list(_tei(rel, raw))
        except ET.ParseError as e:
            return [(bad, str(e), {}, {})]

    rows = stage(_per_file(parse, df), "tei")
    n, failed = df.count(), rows.where(F.col("doc_id") == bad).count()
    if not n:
        raise NotIngestable(f"no Greek TEI files under {root}")
    if failed > n * tolerance:
        raise NotIngestable(f"{failed} of {n} TEI files are malformed")
    return as_records(rows.where(F.col("doc_id") != bad).withColumn("pk", path_key(F.col("rel"))), corpus, ["pk", "i"])


# -- ATF with a catalogue


def read_atf(spark: SparkSession, atf: str) -> DataFrame:
    """``(pnum, designation, text, file, island)``: a tablet per ``&P… = …`` header, its text lines joined by `` / ``; the header order is (file, island)."""
    name = atf.rstrip("/").rsplit("/", 1)
    ls = lines(spark, name[0], name[1])
    head = F.regexp_extract("value", r"^&(P\d+)\s*=\s*(.*)$", 1)
    ls = running_count(ls.withColumn("pnum", head), F.col("pnum") != "", "island").where("island > 0")
    body = F.trim(F.regexp_extract(F.trim("value"), r"^\d+[a-z']*\.\s+(.*)$", 1))
    heads = ls.where("pnum <> ''").select("file", "island", "pnum", F.trim(F.regexp_extract("value", r"^&(P\d+)\s*=\s*(.*)$", 2)).alias("designation"))
    texts = ls.where((F.col("pnum") == "") & (body != "")).groupBy("file", "island").agg(F.array_sort(F.collect_list(F.struct("block", "seq", body.alias("t")))).alias("l"))  # the lines of one tablet
    return heads.join(texts, ["file", "island"]).withColumn("text", F.array_join(F.transform("l", lambda x: x["t"]), " / ")).drop("l")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``(pnum, language, period)``: numeric ids as ``P`` and six digits, blank ids and short rows skipped, the last of equal ids wins."""
    name = path.rsplit("/", 1)
    raw = lines(spark, name[0], name[1])
    header = raw.where((F.col("block") == 0)).orderBy("seq").limit(1).collect()
    if not header:
        raise NotIngestable("the catalogue is empty")
    import csv

    cols = next(csv.reader([header[0]["value"]]))
    id_col = next((c for c in ("id_text", "id", "pnum", "p_number") if c in cols), None)
    if id_col is None:
        raise NotIngestable(f"the catalogue has no tablet id among {sorted(cols)[:40]}")
    schema = ", ".join(f"`c{i}` string" for i in range(len(cols)))
    rows = raw.where(F.col("seq") != header[0]["seq"]).select("block", "seq", F.from_csv("value", F.lit(schema), {"mode": "PERMISSIVE"}).alias("r"))
    get = lambda n: F.nullif(F.trim(F.col(f"r.c{cols.index(n)}")), F.lit("")) if n in cols else F.lit(None).cast("string")
    v = rows.select("block", "seq", get(id_col).alias("id"), get("language").alias("language"), get("period").alias("period")).where("id is not null")
    v = v.withColumn("pnum", F.when(F.col("id").rlike(r"^\d+$"), F.concat(F.lit("P"), F.when(F.length("id") < 6, F.lpad("id", 6, "0")).otherwise(F.col("id")))).otherwise(F.col("id")))
    return v.groupBy("pnum").agg(F.max_by(F.struct("language", "period"), F.struct("block", "seq")).alias("x")).select("pnum", "x.language", "x.period")


def read_cdli(spark: SparkSession, atf: str, catalogue: str, corpus: str = "cuneiform_cdli") -> DataFrame:
    """Tablets left-joined to the catalogue; an absent language or period is an absent key."""
    t = read_atf(spark, require_raw(atf, f"download the ATF dump to {atf}"))
    j = t.join(read_catalogue(spark, require_raw(catalogue, f"download the catalogue to {catalogue}")), "pnum", "left")
    rows = j.select("file", "island", F.col("pnum").alias("doc_id"), F.col("pnum").alias("sent_id"), pairs(text=F.col("text")).alias("fields"), pairs(designation=F.col("designation"), language=F.col("language"), period=F.col("period")).alias("meta"))
    return as_records(rows, corpus, ["file", "island"])


# -- tables and plain lines


def _numbered(df: DataFrame) -> DataFrame:
    """Zero-based line number per file."""
    return ranked_within(df, ["file"], ["block", "seq"], "n")


def read_cognates(spark: SparkSession, path: str, corpus: str, src_name: str, tgt_name: str) -> DataFrame:
    """Two-column table with a header; a blank line is skipped but keeps its number, any other number of columns is an error with the line."""
    name = require_raw(path, f"download the word list to {path}").rsplit("/", 1)
    ls = _numbered(lines(spark, name[0], name[1])).withColumn("p", F.split("value", "\t"))
    width = F.when(F.size("p") == 2, F.col("p"))
    bad = F.concat(F.lit(f"{name[1]}:"), (F.col("n") + 1).cast("string"), F.lit(": expected 2 columns (2-column table)"))
    head = ls.where("n = 0").select(F.coalesce(width, F.raise_error(bad)).alias("p")).collect()
    if not head:
        raise ValueError(f"{path}: expected a 2-column header")
    body = ls.where((F.col("n") > 0) & (F.trim("value") != "")).withColumn("p", F.coalesce(width, F.raise_error(bad)))
    rows = body.select(
        "n", F.lit("cognates").alias("doc_id"), F.format_string(f"{corpus}-p%05d", F.col("n") - 1).alias("sent_id"), pairs(src=F.col("p")[0], tgt=F.col("p")[1]).alias("fields"),
        pairs(src_name=F.lit(src_name), tgt_name=F.lit(tgt_name)).alias("meta"),
    )
    return as_records(rows, corpus, ["n"])


# fixed values: documents of the plain-line corpus and their files, in order
LINE_FILES = {
    "mero-corpus": "mero-corpus.txt",
    "hamadab-stela-amanirenas": "HamadabStelaOfAmanirenasNarrative.txt",
    "kalabsha-kharamadoye": "KalabshaMeroiticInscriptionOfKharamadoyeNarrative.txt",
    "tanyidamani": "TanyidamaniNarrative.txt",
}


def read_lines(spark: SparkSession, root: str, corpus: str = "meroitic_rem", doc_files: dict[str, str] | None = None) -> DataFrame:
    """A record per trimmed line that is not blank, numbered among those of its file."""
    doc_files = doc_files or LINE_FILES
    for f in doc_files.values():
        require_raw(f"{root}/{f}", f"clone the corpus into {root}")
    docs = spark.createDataFrame([(f, d, i) for i, (d, f) in enumerate(doc_files.items())], "file string, doc_id string, place int")
    ls = lines(spark, root, "*.txt").withColumn("value", F.trim(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""))).where("value <> ''").join(F.broadcast(docs), "file")
    n = ranked_within(ls, ["file"], ["block", "seq"], "n")
    rows = n.select("place", "n", "doc_id", F.format_string("%s.%05d", "doc_id", "n").alias("sent_id"), pairs(text=F.col("value")).alias("fields"), F.create_map().cast("map<string,string>").alias("meta"))
    return as_records(rows, corpus, ["place", "n"])


# -- JSON array with images, hosted table


def read_image_entries(spark: SparkSession, root: str, corpus: str = "logogram_egy") -> tuple[DataFrame, DataFrame]:
    """``(records, missing)`` of ``metadata/metadata.json``: entries with text, translation and an existing image; ``missing`` counts those without file.

    Ids use the place in the array, cohorts count emitted entries only.  No
    usable entry is an error.
    """
    meta = require_raw(f"{root}/metadata/metadata.json", f"download the data set into {root}")
    arr = spark.read.option("wholetext", "true").text(meta)
    e = arr.select(F.posexplode(F.from_json("value", "array<struct<tl: string, ta: string, image: string, date: string>>", {"mode": "FAILFAST"})).alias("i", "e"))
    name = F.element_at(F.split("e.image", "/"), -1)
    ok = e.select("i", F.trim("e.tl").alias("tl"), F.trim("e.ta").alias("ta"), name.alias("image_name"), F.trim(F.coalesce(F.nullif("e.date", F.lit("")), F.lit("unknown"))).alias("date"))
    ok = ok.where("coalesce(tl, '') <> '' and coalesce(ta, '') <> '' and coalesce(image_name, '') <> ''")
    there = files(spark, f"{root}/metadata/textline").select(F.col("rel").alias("image_name"))
    used = stage(ok.join(there, "image_name", "left_semi"), "entries")
    if not used.limit(1).count():
        raise NotIngestable(f"{corpus}: no usable entries")
    n = first_seen_number(used, [F.col("date")], "i")
    base = root.rstrip("/").rsplit("/", 1)[-1]
    rows = n.select(
        "i", F.format_string(f"{corpus}-d%03d", "number").alias("doc_id"), F.format_string(f"{corpus}-s%05d", "i").alias("sent_id"),
        pairs(transliteration=F.col("tl"), translation_en=F.col("ta"), image=F.concat(F.lit(f"{base}/metadata/textline/"), "image_name")).alias("fields"), pairs(date=F.col("date")).alias("meta"),
    )
    return as_records(rows, corpus, ["i"]), ok.join(there, "image_name", "left_anti").agg(F.count("*").alias("missing"))


def read_hosted(rows: DataFrame, corpus: str, order: str = "i") -> DataFrame:
    """A hosted sentence table -> records: columns renamed, documents by dating cohort.

    A column that is absent is an absent key; a date that is null is a present
    key with a null value.
    """
    has = set(rows.columns)
    names = {"transliteration": "transliteration", "lemmatization": "lemmatization", "upos": "UPOS", "glossing": "glossing", "translation_de": "translation", "hieroglyphs": "hieroglyphs"}
    fields = F.create_map(*[x for k, c in names.items() if c in has for x in (F.lit(k), F.col(c))])
    null = F.lit(None).cast("string")
    meta = [("dateNotBefore", F.col("dateNotBefore") if "dateNotBefore" in has else null), ("dateNotAfter", F.col("dateNotAfter") if "dateNotAfter" in has else null)]
    meta += [("authors", F.col("authors"))] if "authors" in has else []
    r = rows.select(F.col(order).alias("ord"), fields.alias("fields"), F.create_map(*[x for k, c in meta for x in (F.lit(k), c.cast("string"))]).alias("meta"))
    r = cohort_ids(r, corpus)
    return r.select(F.lit(corpus).alias("corpus"), "doc_id", F.format_string(f"{corpus}-s%06d", "ord").alias("sent_id"), "fields", "meta", F.col("ord").cast("long").alias("ord"))


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files per immediate sub-folder: count, bytes, extensions."""
    from lapidary.operators.census import extension_histogram

    f = files(spark, require_raw(root, f"clone the data into {root}"))
    return extension_histogram(f.where(F.col("rel").contains("/")).select(F.split("rel", "/")[0].alias("subset"), F.col("rel").alias("path"), "length"))
