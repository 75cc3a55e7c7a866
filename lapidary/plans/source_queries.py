"""Queries that write raw files of each format from the test tables and read them again, and queries of the ledger and the store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.functions import text as T
from lapidary.operators import census as C
from lapidary.operators import keys as K
from lapidary.operators import language as G
from lapidary.operators import ledger as L
from lapidary.operators import splits as S
from lapidary.plans.queries import _cognates, _runs, field, query, table
from lapidary.session import Files, shared_root
from lapidary.sources import corpora as R
from lapidary.sources import logs
from lapidary.sources.base import write_files

FILE = 1000  # records of a written file


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}".removeprefix("file://").removeprefix("file:")


def plain(c: Column) -> Column:
    """Words with single blanks between them."""
    return F.array_join(T.words(c), " ")


def _of(spark: SparkSession, d: str, corpus: str, name: str) -> DataFrame:
    """``(ord, part, doc, t)``: values of a field of a corpus that are not blank."""
    r = table(spark, d, "records").where((F.col("corpus") == corpus) & (plain(field(name)) != ""))
    return r.select("ord", F.floor(F.col("ord") / FILE).alias("part"), F.coalesce(F.nullif(plain(F.col("doc_id")), F.lit("")), F.lit("none")).alias("doc"), plain(field(name)).alias("t"), "fields", "meta")


def _joined(rows: DataFrame, line: Column) -> DataFrame:
    """``(part, content)``: lines of a file in order of ``ord``; a file holds FILE records at most."""
    return rows.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "").alias("content"))


def _lines(rows: DataFrame, root: str, one: bool = False) -> None:
    """Write ``(ord, i, value)`` as lines in order, the lines of one ``ord`` in one file."""
    rows = (rows.coalesce(1) if one else rows.repartitionByRange("ord")).sortWithinPartitions("ord", "i")
    rows.select("value").write.text(root)


def _only(spark: SparkSession, root: str) -> str:
    return next(iter(Files(spark).list(root, ".txt"))).removeprefix("file:")


@query
def a3_conllu(spark: SparkSession, d: str) -> DataFrame:
    """Coptic sentences as treebank headers, read again."""
    rows = _of(spark, d, "coptic_scriptorium", "text")
    english = plain(field("translation_en"))
    line = F.concat(F.lit("# newdoc id = "), "doc", F.lit("\n# sent_id = "), F.col("ord").cast("string"), F.lit("\n# text = "), "t", F.when(F.coalesce(english, F.lit("")) != "", F.concat(F.lit("\n# text_en = "), english)).otherwise(""), F.lit("\n1\tx\n\n"))
    root = folder(spark, "conllu")
    write_files(_joined(rows, line).select(F.format_string("sahidic/%08d.conllu", "part").alias("rel"), "content"), root)
    r = R.read_conllu(spark, root)
    return r.select("sent_id", "doc_id", field("text").alias("text"), field("translation_en").alias("english"), F.col("meta")["dialect"].alias("dialect"), "ord")


def _escaped(c: str) -> Column:
    return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query
def a4_osis(spark: SparkSession, d: str) -> DataFrame:
    """Hebrew values as verses with a word element per word, read again."""
    rows = _of(spark, d, "hebrew_morphhb", "text")
    words = F.array_join(F.transform(F.split(_escaped("t"), " "), lambda w: F.concat(F.lit("<w>"), w, F.lit("</w>"))), "")
    line = F.concat(F.lit('<verse osisID="B'), F.col("part").cast("string"), F.lit("."), F.col("ord").cast("string"), F.lit('">'), words, F.lit("</verse>\n"))
    root = folder(spark, "osis")
    write_files(_joined(rows, line).select(F.format_string("%08d.xml", "part").alias("rel"), F.concat(F.lit('<osis xmlns="http://www.bibletechnologies.net/2003/OSIS/namespace">'), "content", F.lit("</osis>")).alias("content")), root)
    return R.read_osis(spark, root).select("sent_id", "doc_id", field("text").alias("text"), "ord")


@query
def a5_tei(spark: SparkSession, d: str) -> DataFrame:
    """Greek values as paragraphs, read again: those with three words or more and a Greek letter."""
    rows = _of(spark, d, "greek_first1k", "text")
    root = folder(spark, "tei")
    body = _joined(rows, F.concat(F.lit("<p>"), _escaped("t"), F.lit("</p>\n")))
    text = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>'), "content", F.lit("</body></text></TEI>"))
    write_files(body.select(F.format_string("tlg0001/tlg001/f%08d.grc1.xml", "part").alias("rel"), text.alias("content")), root)
    return R.read_tei(spark, root).select("sent_id", "doc_id", field("text").alias("text"), "ord")


@query
def a6_a7_tablets(spark: SparkSession, d: str) -> DataFrame:
    """Cuneiform values as transliterated tablets with a catalogue, read and joined again."""
    rows = _of(spark, d, "cuneiform_cdli", "text")
    root = folder(spark, "cdli")
    cut = F.locate(" ", "t")
    ls = F.array(
        F.format_string("&P%06d = %s", "ord", "doc"), F.lit("@tablet"), F.concat(F.lit("1. "), F.when(cut > 0, F.substring(F.col("t"), F.lit(1), cut - 1)).otherwise(F.col("t"))),
        F.when(cut > 0, F.concat(F.lit("2'. "), F.expr("substring(t, locate(' ', t) + 1)"))).otherwise("$ ruling"),
    )
    _lines(rows.select("ord", F.posexplode(ls).alias("i", "value")), f"{root}/atf")
    quoted = lambda k: F.concat(F.lit('"'), F.replace(F.coalesce(plain(F.col("meta")[k]), F.lit("")), F.lit('"'), F.lit("'")), F.lit('"'))
    cat = rows.select("ord", F.lit(0).alias("i"), F.concat_ws(",", F.col("ord").cast("string"), quoted("language"), quoted("period")).alias("value"))
    _lines(spark.createDataFrame([(-1, 0, "id_text,language,period")], "ord long, i int, value string").unionByName(cat), f"{root}/cat", one=True)
    t = R.read_atf(spark, f"{root}/atf/part-*").join(R.read_catalogue(spark, f"{root}/cat/part-*"), "pnum", "left")
    return t.select("pnum", F.trim("designation").alias("designation"), "text", "language", "period")


@query
def a8_word_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Cognates as a two-column table with a header, read again."""
    p = _cognates(spark, d).select("ord", F.concat_ws("\t", plain(F.col("src")), plain(F.col("tgt"))).alias("value")).where(F.trim(F.replace("value", F.lit("\t"), F.lit(""))) != "")
    root = folder(spark, "cog")
    _lines(spark.createDataFrame([(-1, 0, "a\tb")], "ord long, i int, value string").unionByName(p.select("ord", F.lit(0).alias("i"), "value")), root, one=True)
    return R.read_cognates(spark, _only(spark, root), "cog", "a", "b").select("sent_id", field("src").alias("src"), field("tgt").alias("tgt"), F.col("meta")["src_name"].alias("name"))


@query
def a9_plain_lines(spark: SparkSession, d: str) -> DataFrame:
    """Meroitic values as plain lines with blank lines between them, read again."""
    rows = _of(spark, d, "meroitic_rem", "text")
    root = folder(spark, "lines")
    _lines(rows.select("ord", F.posexplode(F.array("t", F.lit("  "))).alias("i", "value")), root, one=True)
    r = R.read_lines(spark, root, doc_files={"rem": _only(spark, root).rsplit("/", 1)[-1]})
    return r.select("sent_id", "doc_id", field("text").alias("text"), "ord")


@query
def a10_image_entries(spark: SparkSession, d: str) -> DataFrame:
    """Coptic texts with a translation as entries of a JSON array, with images for those whose document is known; entries without image are left out."""
    r = table(spark, d, "records").where((F.coalesce(plain(field("text")), F.lit("")) != "") & (F.coalesce(plain(field("translation_en")), F.lit("")) != ""))
    e = r.select("ord", "doc_id", plain(field("text")).alias("tl"), plain(field("translation_en")).alias("ta"), F.format_string("x/%d.png", "ord").alias("image"), F.coalesce(F.trim(F.col("meta")["period"]), F.lit("")).alias("date"))
    root = folder(spark, "egy")
    write_files(e.where("doc_id is not null").select(F.concat(F.lit("metadata/textline/"), F.col("ord").cast("string"), F.lit(".png")).alias("rel"), F.lit("png").alias("content")), root)
    array = e.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tl", "ta", "image", "date"))), lambda x: F.struct(x["tl"].alias("tl"), x["ta"].alias("ta"), x["image"].alias("image"), x["date"].alias("date")))).alias("content"))  # the format is one array
    write_files(array.select(F.lit("metadata/metadata.json").alias("rel"), "content"), root)
    got, missing = R.read_image_entries(spark, root)
    name = F.element_at(F.split(field("image"), "/"), -1)
    return got.select("doc_id", "sent_id", field("transliteration").alias("text"), field("translation_en").alias("english"), name.alias("image"), F.col("meta")["date"].alias("date")).crossJoin(F.broadcast(missing))  # one row


@query
def a11_hosted_table(spark: SparkSession, d: str) -> DataFrame:
    """Records of the Demotic corpus as the hosted table has them, read as records: dating cohorts as documents (C3)."""
    r = table(spark, d, "records").where("corpus = 'tla_demotic'")
    m = F.col("meta")
    hosted = r.select(F.col("ord").alias("i"), *[field(k).alias(c) for k, c in (("transliteration", "transliteration"), ("lemmatization", "lemmatization"), ("upos", "UPOS"), ("translation_de", "translation"))], *[m[k].alias(k) for k in ("dateNotBefore", "dateNotAfter", "authors")])
    got = R.read_hosted(hosted, "tla")
    return got.select("ord", "doc_id", "sent_id", field("translation_de").alias("german"), field("upos").alias("upos"), F.size("fields").alias("n_fields"), F.col("meta")["authors"].alias("authors"))


@query
def a12_inventory(spark: SparkSession, d: str) -> DataFrame:
    """A file per source and domain, as long as it has documents; files, bytes and endings per source."""
    word = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit("none"))), "[^a-z0-9]", "_")
    f = table(spark, d, "documents").groupBy(word(F.col("source")).alias("s"), word(F.col("domain")).alias("e")).agg(F.count("*").alias("n"))
    root = folder(spark, "inventory")
    write_files(f.select(F.concat("s", F.lit("/deep/all."), "e").alias("rel"), F.repeat(F.lit("x"), F.col("n").cast("int")).alias("content")), root)
    return R.read_inventory(spark, root).select("subset", "files", "bytes", F.explode("by_extension").alias("ext", "n"))


@query
def a16_training_logs(spark: SparkSession, d: str) -> DataFrame:
    """A log file per run, read again; unfinished runs have no last line and do not come out."""
    r = _runs(spark, d).where(F.col("run_id").rlike(r"^\S+$"))
    done = F.when(F.col("status") == "completed", F.concat(F.lit("[train] done: "), F.coalesce("seed", F.lit(0)).cast("string"), F.lit(" steps, loss 2.5 -> 1.5, best_eval="), F.when(F.isnull("value"), "0.25").otherwise("0.5"), F.lit("\n"))).otherwise("")
    root = folder(spark, "logs")
    write_files(r.select(F.concat(F.lit("slurm-"), "run_id", F.lit(".out")).alias("rel"), F.concat(F.lit("[train] 1,234 params -> runs/"), "run_id", F.lit("\nepoch 1\n"), done).alias("content")), root)
    return logs.read_logs(spark, root)


@query
def a17_pattern_gate(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the documents with a colon or semicolon, found in text files."""
    root = folder(spark, "gate")
    table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")).where(~F.col("value").rlike("[\r]")).write.text(root)
    return logs.forbidden_lines(spark, root, "[;:]", "*.txt").groupBy("value").agg(F.count("*").alias("n"))


# -- joins and keys


@query
def j6_present_entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the sources that the mixture lists; the others are counted."""
    e = table(spark, d, "documents").select("doc_id", "source")
    there, missing = C.present_only(e, table(spark, d, "mix_targets").select("source"), "source")
    return there.select("doc_id", "source").crossJoin(F.broadcast(missing))  # one row


@query
def j10_key_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """A key by rank of frequency, between the two sides of the cognates, against the identity (G20)."""
    alphabet = list("abcdefghijklmnopqrstuvwxyz")
    p = _cognates(spark, d)
    key = G.rank_match(G.char_frequencies(p, alphabet, "src"), G.char_frequencies(p, alphabet, "tgt"))
    return G.key_accuracy(key, spark.createDataFrame([(c, c) for c in alphabet], "src string, tgt string")).select(F.round("accuracy", 9).alias("accuracy"))


@query
def w7_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 records by id and order."""
    return K.first_rows(table(spark, d, "records").select("sent_id", "ord"), 100, ["sent_id", "ord"])


@query
def s7_schemes(spark: SparkSession, d: str) -> DataFrame:
    """Split by scheme name: part sizes of the Demotic corpus under three schemes."""
    r = table(spark, d, "records").where("corpus = 'tla_demotic'")
    meta = {"kind": "parallel", "primary_field": "transliteration", "translation_field": "translation_de"}
    out = [S.apply_scheme(s, r, meta)[0].groupBy("part").agg(F.count("*").alias("n")).select(F.lit(s).alias("scheme"), "part", "n") for s in ("random", "document_heldout", "period_heldout")]
    return out[0].unionByName(out[1]).unionByName(out[2])


# -- ledger and store


def _events(spark: SparkSession, d: str) -> str:
    """The runs of the test table as event files: registrations in the canonical file, ends in shards, some twice."""
    r = _runs(spark, d).where("run_id is not null")
    text = lambda k, c: (k, F.coalesce(F.col(c).cast("string"), F.lit("")))

    def lines(kind: str, cols: list) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("event"), *[c.alias(k) for k, c in cols], F.coalesce("seed", F.lit(0)).alias("seed")))

    reg = r.select(lines("register", [text("run_id", "run_id"), text("timestamp", "registered_at"), text("family", "family"), text("phase", "phase"), text("notes", "hypothesis")]).alias("value"))
    end = r.where(F.col("status").isin(*L.TERMINAL)).select(lines("complete", [text("run_id", "run_id"), text("timestamp", "completed_at"), text("status", "status"), text("notes", "notes")]).alias("value"))
    root = folder(spark, "ledger")
    reg.coalesce(1).write.text(f"{root}/main")
    end.unionByName(end).write.text(f"{root}/more")
    return root


@query
def l4_folded_events(spark: SparkSession, d: str) -> DataFrame:
    """Event files folded to runs (J7, D6): ends that were written twice count once."""
    root = _events(spark, d)
    runs = L.fold(L.read_events(spark, root, "*.txt"))
    return runs.select("run_id", "registered_at", "family", "phase", "status", F.nullif("completed_at", F.lit("")).alias("completed_at"), "notes", "seed")


@query
def l7_merged_lines(spark: SparkSession, d: str) -> DataFrame:
    """Set union of two copies of a ledger that differ in their ends."""
    root = _events(spark, d)
    line = lambda p: spark.read.text(f"{root}/{p}").select(F.col("value").alias("line"))
    return L.merge_lines(line("main").unionByName(line("more")), line("more")).select(F.get_json_object("line", "$.event").alias("event"), F.get_json_object("line", "$.run_id").alias("run_id"))


@query
def j14_missing_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with an end in the messages whose registration is not among the runs that are still open."""
    r = _runs(spark, d)
    ended = r.where("status = 'completed'")
    return L.missing_runs(ended.select("run_id", "seed"), r.select("run_id", "config_hash"), r.where("family is null or status <> 'completed'")).select("run_id", "seed", "config_hash")


@query
def b13_report_values(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 values of each family, as the report prints them, by place."""
    v = L.family_value_list(_runs(spark, d))
    return v.select("family", F.posexplode("values").alias("place", "value")).select("family", "place", F.round("value", 9).alias("value"))


@query
def i1_store(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a split written to the store, frozen and read back through it: rows per part, reads of the test part in the audit."""
    from lapidary.operators.integrity import Store, run_context

    store = Store(spark, folder(spark, "store"))
    store.write(S.split_document(table(spark, d, "records")), "records", "document_heldout")
    store.freeze("records", "document_heldout")
    with run_context("query"):
        parts = [(p, store.read("records", "document_heldout", part=p).count()) for p in S.PARTS]
    logged = store.audit().where("run_id = 'query'").count()
    intact = not store.verify()
    return spark.createDataFrame([(p, n, logged, intact) for p, n in parts], "part string, n long, logged long, intact boolean")
