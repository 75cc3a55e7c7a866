"""The corpora that are known, how each is read, and which splits it gets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lapidary.sources import corpora as C
from lapidary.sources.base import NotIngestable, require_raw


@dataclass(frozen=True)
class Corpus:
    name: str
    kind: str
    primary_field: str | None
    translation_field: str | None = None
    translation_lang: str | None = None
    schemes: tuple[str, ...] = ()
    read: Callable[[SparkSession, str], DataFrame] | None = None
    blocked: str | None = None

    def records(self, spark: SparkSession, root: str) -> DataFrame:
        """Records of the raw folder ``root``; a corpus that cannot be had says why."""
        if self.blocked or self.read is None:
            raise NotIngestable(f"{self.name}: {self.blocked or 'inventory only'}")
        return self.read(spark, root)


_BASE = ("random", "document_heldout", "dedup")


def _hosted(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, root: str) -> DataFrame:
        from lapidary.operators.keys import with_ord

        raw = spark.read.parquet(require_raw(root, f"download the data set {name} into {root}"))
        return C.read_hosted(with_ord(raw.withColumn("__at", C.F.struct("_metadata.file_path", "_metadata.row_index")), ["__at"], "i").drop("__at"), name)

    return read


CORPORA = {
    c.name: c
    for c in (
        Corpus("tla_earlier_egyptian", "parallel", "hieroglyphs", "translation_de", "de", (*_BASE, "period_heldout", "sign_heldout"), _hosted("tla_earlier_egyptian")),
        Corpus("tla_late_egyptian", "parallel", "hieroglyphs", "translation_de", "de", (*_BASE, "sign_heldout"), _hosted("tla_late_egyptian")),
        Corpus("tla_demotic", "parallel", "transliteration", "translation_de", "de", (*_BASE, "period_heldout"), _hosted("tla_demotic")),
        Corpus("coptic_scriptorium", "monolingual", "text", "translation_en", "en", _BASE, C.read_conllu),
        Corpus("hebrew_morphhb", "monolingual", "text", None, None, _BASE, C.read_osis),
        Corpus("ugaritic_hebrew_cognates", "cognate_pairs", "src", None, None, (), lambda s, r: C.read_cognates(s, f"{r}/uga-heb.no_spe.cog", "ugaritic_hebrew_cognates", "uga", "heb")),
        Corpus("linearb_greek_cognates", "cognate_pairs", "src", None, None, (), lambda s, r: C.read_cognates(s, f"{r}/linear_b-greek.cog", "linearb_greek_cognates", "linear_b", "greek")),
        Corpus("logogram_nlp", "inventory", None),
        Corpus("logogram_egy", "parallel", "image", "translation_en", "en", _BASE, lambda s, r: C.read_image_entries(s, r)[0]),
        Corpus("greek_first1k", "monolingual", "text", None, None, _BASE, C.read_tei),
        Corpus("cuneiform_cdli", "monolingual", "text", None, None, (*_BASE, "period_heldout"), lambda s, r: C.read_cdli(s, f"{r}/cdliatf_unblocked.atf", f"{r}/cdli_cat.csv")),
        Corpus("meroitic_rem", "monolingual", "text", None, None, (), C.read_lines),
        Corpus("linear_b_damos", "stub", None, blocked="a web database without bulk export"),
        Corpus("mayan", "stub", None, blocked="no open bulk download; ask the projects"),
        Corpus("libyco_berber", "stub", None, blocked="the database is gone; recover it from web archives"),
    )
}


def registry_table(spark: SparkSession) -> DataFrame:
    rows = [(c.name, c.kind, c.primary_field, c.translation_field, c.translation_lang, list(c.schemes)) for c in CORPORA.values()]
    return spark.createDataFrame(rows, "corpus string, kind string, primary_field string, translation_field string, translation_lang string, schemes array<string>")
