"""Queries over the test tables.

Each takes a session and the folder of the tables and runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.functions import arrays as A
from lapidary.functions import text as T
from lapidary.operators import census as C
from lapidary.operators import dedup as D
from lapidary.operators import evaluation as E
from lapidary.operators import keys as K
from lapidary.operators import language as G
from lapidary.operators import ledger as L
from lapidary.operators import splits as S
from lapidary.session import ranked_within

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def field(name: str):
    return F.col("fields")[name]


# -- flagship: leak-proof split census


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents split by document; evaluation texts that stand in train are removed; census of what is left.

    Texts stay where they are read: a digest of the trimmed text and the number
    of its tokens are all that moves.
    """
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.trim("text")).alias("t"), T.token_count("text").alias("tokens"))
    split = S.split_document(docs)
    train = split.where("part = 'train'").select("t").distinct()
    flagged = split.join(train.withColumn("there", F.lit(True)), "t", "left")
    gone = (F.col("part") != "train") & F.coalesce("there", F.lit(False))
    return flagged.groupBy("part").agg(
        F.count("*").alias("n_checked"), F.count_if(gone).alias("removed_exact"), F.countDistinct(F.when(~gone, F.col("doc_id"))).alias("n_docs"),
        F.sum(F.when(~gone, F.col("tokens")).otherwise(0)).alias("n_tokens"),
    )


@query
def flagship_split_census(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)


# -- sources


@query
def a1_jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON lines and read again; order, ids, fields and meta survive."""
    import uuid

    from lapidary.session import shared_root
    from lapidary.sources.records import read_jsonl, write_jsonl

    path = f"{shared_root(spark)}/jsonl-{uuid.uuid4().hex[:8]}"
    write_jsonl(table(spark, d, "records"), path)
    back = read_jsonl(spark, path)
    return back.select("ord", "corpus", "doc_id", "sent_id", F.size("fields").alias("n_fields"), F.size("meta").alias("n_meta"), *[field(k).alias(k) for k in ("text", "hieroglyphs", "translation_de", "src")], *[F.col("meta")[k].alias(k) for k in ("authors", "dateNotBefore")])


# -- scalar text functions


@query
def b1_normalized(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records").where(F.map_contains_key("fields", "translation_de"))
    return r.select("ord", T.normalize_target(field("translation_de")).alias("norm"))


@query
def b2_signs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").select("ord", F.explode(T.extract_signs(field("hieroglyphs"))).alias("sign"))


@query
def b3_prepared_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").where(field("hieroglyphs").isNotNull()).select("ord", T.prepare_text(field("hieroglyphs")).alias("prepared"))


@query
def b4_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").select("ord", T.token_count(field("text")).alias("n_text"), T.token_count(field("translation_de")).alias("n_translation"))


@query
def b5_period_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").groupBy("corpus", T.period_bucket(F.col("meta")["dateNotBefore"]).alias("bucket")).agg(F.count("*").alias("n"))


@query
def b6_enciphered(spark: SparkSession, d: str) -> DataFrame:
    key = dict(zip("abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm"))
    back = {v: k for k, v in key.items()}
    r = table(spark, d, "records").where(field("src").isNotNull())
    return r.select("ord", T.encipher(field("src"), key).alias("cipher"), T.encipher(T.encipher(field("src"), key), back).alias("plain"))


@query
def b7_test_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.lit("/srv/data/"), "corpus", F.lit("/splits/"), "scheme", F.lit("/"), "tag", F.lit("/"), "part", F.lit("/records.jsonl"))
    return table(spark, d, "split_parts").select("corpus", p.alias("path")).distinct().select("path", T.is_test_path("path").alias("is_test"))


@query
def b8_run_timestamps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_records").select("delivery_id", F.unix_seconds(T.run_timestamp(F.trim("run_id"))).alias("started"))


@query
def b9_b10_field_selection(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records")
    return r.groupBy("corpus").agg(
        F.count_if(T.filled("fields", "translation_de")).alias("filled"), F.count_if(T.parallel_pair("fields", "transliteration", "translation_de")).alias("parallel"), F.count_if(F.map_contains_key("fields", "translation_de")).alias("present")
    )


@query
def b11_fonts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpora").select("corpus", T.font_of("corpus").alias("font"))


# -- keys


@query
def c1_unique_ids(spark: SparkSession, d: str) -> DataFrame:
    return K.unique_ids(table(spark, d, "records").select("ord", "sent_id"))


@query
def c2_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return K.cohort_ids(table(spark, d, "records").select("ord", "meta"), "x").select("ord", "doc_id")


@query
def c4_running_index(spark: SparkSession, d: str) -> DataFrame:
    return K.running_index(table(spark, d, "records").select("corpus", "ord"), "corpus", ["ord"], 6)


# -- splits


@query
def s1_split_document(spark: SparkSession, d: str) -> DataFrame:
    return S.split_document(table(spark, d, "records")).select("ord", "part")


@query
def s2_split_random(spark: SparkSession, d: str) -> DataFrame:
    return S.split_random(table(spark, d, "records")).select("ord", "part", "rank")


@query
def s5_split_metadata(spark: SparkSession, d: str) -> DataFrame:
    return S.split_metadata(table(spark, d, "records"), "authors").select("ord", "part")


@query
def s6_split_period(spark: SparkSession, d: str) -> DataFrame:
    return S.split_period(table(spark, d, "records")).select("ord", "part")


@query
def s8_split_sign_heldout(spark: SparkSession, d: str) -> DataFrame:
    return S.split_sign_heldout(table(spark, d, "records").where(field("hieroglyphs").isNotNull()))[0].select("ord", "part")


@query
def s8_sign_ranks(spark: SparkSession, d: str) -> DataFrame:
    return S.sign_ranks(table(spark, d, "records"))


@query
def s9_split_by_document_count(spark: SparkSession, d: str) -> DataFrame:
    return S.split_by_document_count(table(spark, d, "records").where("doc_id is not null"), S.RATIOS).select("ord", "part")


# -- joins and dedup


@query
def j1_catalogue_join(spark: SparkSession, d: str) -> DataFrame:
    c = F.broadcast(table(spark, d, "corpora").select("corpus", "domain", "primary_lang"))  # a row per corpus
    return table(spark, d, "records").join(c, "corpus", "left").groupBy("domain", "primary_lang").agg(F.count("*").alias("n"))


@query
def j4_exact_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows whose trimmed text stands in train (left semi join)."""
    r = table(spark, d, "records").where(field("text").isNotNull()).select("ord", "doc_id", F.md5(F.trim(field("text"))).alias("t"))
    s = S.split_document(r)
    return s.where("part <> 'train'").join(s.where("part = 'train'").select("t").distinct(), "t", "left_semi").select("ord", "part")


def _translated(spark: SparkSession, d: str) -> DataFrame:
    """Records with a German translation, without the fields and columns that deduplication does not read."""
    r = table(spark, d, "records").where(F.map_contains_key("fields", "translation_de"))
    return r.select("ord", "doc_id", F.map_filter("fields", lambda k, v: k == "translation_de").alias("fields"))


@query
def d1_dedup_flags(spark: SparkSession, d: str) -> DataFrame:
    """Exact and near removal against train on the German translations."""
    return D.dedup_flags(S.split_document(_translated(spark, d)), "translation_de").select("ord", "part", "removed")


@query
def d1_dedup_report(spark: SparkSession, d: str) -> DataFrame:
    return D.dedup_report(D.dedup_flags(S.split_document(_translated(spark, d)), "translation_de"))


@query
def d5_new_ledger_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of later batches that no earlier one had."""
    # a line is new in the first batch that has it, unless that is the first of all: over all batches, the later lines less those of the first
    r = table(spark, d, "run_records").select(F.concat_ws("|", "run_id", "status", "completed_at").alias("line"), F.col("batch_id").alias("b"))
    r = r.crossJoin(F.broadcast(r.agg(F.min("b").alias("first"))))  # one row
    return D.drop_known_lines(r.where("b > first").select("line"), r.where("b = first").select("line")).select(F.trim("line").alias("line"))


# -- statistics


@query
def g1_ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.ingest_stats(table(spark, d, "records"), table(spark, d, "corpora"))


@query
def g1_field_coverage(spark: SparkSession, d: str) -> DataFrame:
    return C.field_coverage(table(spark, d, "records"))


@query
def g2_census(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpora")
    return C.census(c.select("corpus", "kind"), C.ingest_stats(table(spark, d, "records"), c))


@query
def g4_extension_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: name from language, size from length."""
    doc = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("subset"), F.concat(F.col("doc_id").cast("string"), F.lit("."), F.coalesce("domain", F.lit("txt"))).alias("path"), F.coalesce("n_chars", F.lit(0)).alias("length"))
    h = C.extension_histogram(doc)
    return h.select("subset", "files", "bytes", F.explode("by_extension").alias("ext", "n"))


def _cognates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").where(field("src").isNotNull() & field("tgt").isNotNull()).select("ord", field("src").alias("src"), field("tgt").alias("tgt"))


ALPHABET = list("abcdefghijklmnopqrstuvwxyz")


@query
def g5_char_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return G.char_frequencies(_cognates(spark, d), ALPHABET, "src").select("ch", "pos", F.round("freq", 9).alias("freq"))


@query
def j11_rank_match(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records")
    a = r.where(field("transliteration").isNotNull()).select(field("transliteration").alias("text"))
    return G.rank_match(G.char_frequencies(_cognates(spark, d), ALPHABET, "src"), G.char_frequencies(a, ALPHABET))


def _train_eval(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "split_parts").where("scheme = 'random' and tag = 'v1'").groupBy("ord").agg(F.min("part").alias("part"))
    r = table(spark, d, "records").where(field("text").isNotNull()).select("ord", field("text").alias("text")).join(p, "ord")
    return r.where("part = 'train'"), r.where("part = 'valid'")


@query
def g7_unigram_entropy(spark: SparkSession, d: str) -> DataFrame:
    ce = G.unigram_entropy(*_train_eval(spark, d))
    return ce.select(F.round("ce", 8).alias("ce"), F.round(T.nats_to_bits("ce"), 8).alias("bits"))


@query
def g8_bigram_entropy(spark: SparkSession, d: str) -> DataFrame:
    return G.bigram_entropy(*_train_eval(spark, d)).select(F.round("ce", 8).alias("ce"))


@query
def g9_char_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return G.char_vocabulary(table(spark, d, "records").where(field("text").isNotNull()).select("ord", field("text").alias("text")))


@query
def g19_token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Words of the cognates after a cipher and back, against the originals."""
    key = dict(zip("abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyza"))
    p = _cognates(spark, d).select(F.col("src").alias("ref"), T.encipher("src", {k: v for k, v in key.items() if k in "aeiou"}).alias("hyp"))
    return G.token_accuracy(p, "hyp", "ref").select(F.round("accuracy", 9).alias("accuracy"))


# -- ledger


def _runs(spark: SparkSession, d: str) -> DataFrame:
    runs = L.latest_state(table(spark, d, "run_records"))
    return runs.withColumn("value", L.metric("all_metrics", F.col("selection_metric")))


@query
def l4_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("run_id", "family", "status", "seed", "config_hash", F.round("value", 9).alias("value"))


@query
def g10_family_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.family_counts(_runs(spark, d))


@query
def g11_family_values(spark: SparkSession, d: str) -> DataFrame:
    v = L.family_values(_runs(spark, d))
    return v.select("family", "n_values", *[F.round(c, 9).alias(c) for c in ("best", "median", "worst")])


@query
def g14_rank_stability(spark: SparkSession, d: str) -> DataFrame:
    # runs of one metric count as one configuration: the hashes of this ledger hardly repeat
    runs = _runs(spark, d).withColumn("config_hash", F.col("selection_metric"))
    return L.rank_stability(runs).select("family", "n_seed_pairs", F.round("rank_stability", 9).alias("rank_stability"))


@query
def g15_kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of price and quantity rankings of brands, by part type."""
    p = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("a"), F.avg("p_size").alias("b"))
    return L.kendall_tau(p, ["p_type"], "p_brand", "a", "b").select("p_type", "n", F.when(F.isnan("tau"), None).otherwise(F.round("tau", 9)).alias("tau"))


@query
def w2_variants_so_far(spark: SparkSession, d: str) -> DataFrame:
    return L.variants_so_far(_runs(spark, d)).select("run_id", "family", "n_variants")


@query
def b12_run_list(spark: SparkSession, d: str) -> DataFrame:
    return L.list_runs(_runs(spark, d), status="failed").select("run_id", "family", "phase")


# -- restoration and calibration: all signs by frequency as a ranked guess at the last sign of a record


def _slots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = table(spark, d, "records").where(field("hieroglyphs").isNotNull()).select("ord", T.extract_signs(field("hieroglyphs")).alias("s")).where(F.size("s") > 0)
    counts = r.select(F.explode("s").alias("sign")).groupBy("sign").agg(F.count("*").alias("c"))
    ranked = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("neg"), "sign", "c"))).alias("x"), F.sum("c").alias("t"))  # the alphabet
    lists = ranked.select(F.transform("x", lambda e: e["sign"]).alias("labels"), F.transform("x", lambda e: e["c"] / F.col("t")).alias("probs"))
    slots = r.groupBy(F.element_at("s", -1).alias("truth")).agg(F.count("*").alias("weight"))  # slots with the same list and truth are equal
    return slots.crossJoin(F.broadcast(lists)), counts  # one row


@query
def g16_recall(spark: SparkSession, d: str) -> DataFrame:
    slots, counts = _slots(spark, d)
    r = E.recall_at(slots, E.frequency_bins(counts))
    return r.select("bin", "n_slots", *[F.round(f"recall_{k}", 9).alias(f"recall_{k}") for k in (1, 5, 20)])


@query
def g17_frequency_bins(spark: SparkSession, d: str) -> DataFrame:
    return E.frequency_bins(_slots(spark, d)[1])


@query
def g18_calibration_error(spark: SparkSession, d: str) -> DataFrame:
    """Confidence: discount of a line item x 9; correct: it was returned."""
    p = table(spark, d, "lineitem").select((F.col("l_discount") * 9).alias("conf"), (F.col("l_returnflag") == "R").alias("correct"))
    return E.calibration_error(p).select(F.round("ece", 8).alias("ece"))


@query
def g21_conformal_threshold(spark: SparkSession, d: str) -> DataFrame:
    return E.conformal_threshold(_slots(spark, d)[0]).select(F.round("qhat", 9).alias("qhat"), "n")


@query
def g22_conformal_sets(spark: SparkSession, d: str) -> DataFrame:
    slots, _ = _slots(spark, d)
    s = E.conformal_sets(slots, E.conformal_threshold(slots))
    return s.select(F.round("coverage", 9).alias("coverage"), F.round("mean_size", 9).alias("mean_size"), "median_size", "n")


@query
def g23_block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    b = E.block_bootstrap(table(spark, d, "documents"), "n_chars")
    return b.select(*[F.round(c, 6).alias(c) for c in ("point", "low", "high")], "n_docs")


@query
def g24_paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").select("doc_id", F.length("text").alias("a"), (F.length("text") - F.pmod("doc_id", F.lit(7)) + 3).alias("b"))
    b = E.paired_bootstrap(doc, "a", "b")
    return b.select(*[F.round(c, 6).alias(c) for c in ("delta", "low", "high", "p_value")], "significant")


@query
def g25_chrf_bleu(spark: SparkSession, d: str) -> DataFrame:
    """The first against the second translation of a document position: German texts of neighbouring records."""
    r = table(spark, d, "records").where(field("translation_de").isNotNull())
    at = ranked_within(r.select("corpus", "doc_id", "ord", field("translation_de").alias("t")), ["corpus", "doc_id"], ["ord"], "k")
    later, earlier = at.select("corpus", F.coalesce("doc_id", F.lit("\x00")).alias("d"), "k", F.col("ord").alias("id"), F.col("t").alias("hyp")), at.select("corpus", F.coalesce("doc_id", F.lit("\x00")).alias("d"), (F.col("k") + 1).alias("k"), F.col("t").alias("ref"))
    scores = E.corpus_scores(later.join(earlier, ["corpus", "d", "k"]).select("id", "hyp", "ref"))
    return scores.select(*[F.round(c, 6).alias(c) for c in ("chrf", "chrf_plus", "bleu")])


@query
def g26_sentence_chrf(spark: SparkSession, d: str) -> DataFrame:
    p = _cognates(spark, d).select(F.col("ord").alias("id"), F.col("src").alias("hyp"), F.col("tgt").alias("ref"))
    return E.sentence_chrf(p).select("id", F.round("chrf", 6).alias("chrf"))


# -- arrays: embeddings as lines of a strip


@query
def w10_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(A.row_windows(F.col("embedding"))).alias("i", "w"))
    return e.select("vec_id", "i", F.size("w").alias("width"), F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query
def w5_moving_average(spark: SparkSession, d: str) -> DataFrame:
    row = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(A.moving_average(row, 3)).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


@query
def r13_standardised(spark: SparkSession, d: str) -> DataFrame:
    row = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(A.standardise(row)).alias("i", "x")).select("vec_id", "i", F.round("x", 5).alias("x"))


@query
def g28_ink_fraction(spark: SparkSession, d: str) -> DataFrame:
    strip = F.array(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(A.ink_fraction(strip), 9).alias("ink"))


@query
def r11_trimmed(spark: SparkSession, d: str) -> DataFrame:
    strip = F.array(F.transform("embedding", lambda x: (1 - F.abs(x) * 4).cast("float")))
    return table(spark, d, "embeddings").select("vec_id", F.size(A.trim_to_ink(strip)[0]).alias("width"))


@query
def r10_damaged_strips(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.array(*[F.col("embedding")] * 3).alias("strip"))
    return A.damaged(e, "strip", "vec_id", 7, 0.5).select("vec_id", F.round(A.ink_fraction(F.col("strip")), 9).alias("ink"))


@query
def r15_mask_plans(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records").where(field("hieroglyphs").isNotNull())
    n = F.size(T.extract_signs(field("hieroglyphs")))
    return r.select("ord", n.alias("n_signs"), F.size(A.mask_column(n, "damage", F.col("ord"), 7)).alias("n_hidden"))


# -- integrity


@query
def i4_frozen_parts(spark: SparkSession, d: str) -> DataFrame:
    """Split, write, freeze, verify and read again through the store."""
    import uuid

    from lapidary.operators.integrity import Store, run_context
    from lapidary.session import shared_root

    store = Store(spark, shared_root(spark).removeprefix("file://").removeprefix("file:") + f"/store-{uuid.uuid4().hex[:8]}")
    store.write(S.split_document(table(spark, d, "records")), "records", "document_heldout")
    digest = store.freeze("records", "document_heldout")
    with run_context("query"):
        test = store.read("records", "document_heldout", part="test")
    rows = [("records/document_heldout/v1/test", digest, not store.verify(), test.count())]
    return spark.createDataFrame(rows, "key string, sha256 string, intact boolean, n_rows long")


# -- messages delivered more than once


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from lapidary.operators.messages import surplus_deliveries

    return surplus_deliveries(table(spark, d, "run_records"))


# -- end to end


@query
def m11_smoke(spark: SparkSession, d: str) -> DataFrame:
    """The toy cipher, from generation to the ledger; it needs none of the tables."""
    import uuid

    from lapidary.plans.smoke import run_smoke
    from lapidary.session import shared_root

    r = run_smoke(spark, shared_root(spark).removeprefix("file://").removeprefix("file:") + f"/smoke-{uuid.uuid4().hex[:8]}")
    return spark.createDataFrame([tuple(float(r[k]) for k in ("key_accuracy", "valid_accuracy", "test_accuracy"))], "key_accuracy double, valid_accuracy double, test_accuracy double")


@query
def r17_glyph_strips(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic glyph strips of the signs of a record: how many windows they give and their ink."""
    s = table(spark, d, "records").where(field("hieroglyphs").isNotNull()).select("ord", T.extract_signs(field("hieroglyphs")).alias("signs"))
    return A.rendered_facts(s, "signs").select("ord", A.window_count(F.col("width")).alias("n_windows"), F.round("ink", 9).alias("ink"))
