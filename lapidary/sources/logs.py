"""Training logs, source gates and report freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.sources.base import relative, whole_files

# fixed values: the two lines of a finished training log
DONE = r"\[train\] done: (\d+) steps, loss ([\d.]+) -> ([\d.]+), best_eval=([\d.a-z]+)"
PARAMS = r"\[train\] ([\d,]+) params -> (\S+)"


def read_logs(spark: SparkSession, root: str, glob: str = "slurm-*.out") -> DataFrame:
    """A row per run with both lines; the later file of a run wins; ``best_eval`` may be infinite."""
    t = whole_files(spark, root, glob).select("rel", F.decode("content", "UTF-8").alias("t"))
    p, d = lambda i: F.regexp_extract("t", PARAMS, i), lambda i: F.regexp_extract("t", DONE, i)
    best = F.when(d(4) == "inf", F.lit(float("inf"))).otherwise(d(4).try_cast("double"))
    rows = t.where((p(2) != "") & (d(1) != "")).select(
        F.element_at(F.split(p(2), "/"), -1).alias("run_id"), F.regexp_extract("rel", r"slurm-([^/]*)\.[^./]*$", 1).alias("job"), F.regexp_replace(p(1), ",", "").cast("long").alias("params"),
        d(1).cast("long").alias("steps"), d(2).cast("double").alias("first_loss"), d(3).cast("double").alias("last_loss"), best.alias("best_eval"), "rel",
    )
    cols = [c for c in rows.columns if c not in ("run_id", "rel")]
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*cols), "rel").alias("x")).select("run_id", "x.*")


def forbidden_lines(spark: SparkSession, root: str, pattern: str, glob: str = "*.py", exclude: str | None = None) -> DataFrame:
    """``(file, value)`` of the source lines that match ``pattern``; paths containing ``exclude`` are let through. A gate passes if there are none."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    rows = raw.select(relative(F.regexp_replace(F.col("_metadata.file_path"), "^file:", ""), root).alias("file"), "value").where(F.col("value").rlike(pattern))
    return rows.where(~F.col("file").contains(exclude)) if exclude else rows


def stale_reports(spark: SparkSession, root: str, source: str = ".tex", product: str = ".pdf") -> DataFrame:
    """``(stem, why)`` of main documents (those with a document class) whose product is missing or older, or that carry no report stamp."""
    read = lambda e: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{e}").load(root)
    stem = lambda e: F.regexp_replace("path", "\\" + e + "$", "").alias("stem")
    text = F.decode("content", "UTF-8")
    src = read(source).where(text.contains("\\documentclass")).select(stem(source), F.col("modificationTime").alias("written"), F.regexp_extract(text, r"\\newcommand\{\\ReportStamp\}\{([^}]*)\}", 1).alias("stamp"))
    out = read(product).select(stem(product), F.col("modificationTime").alias("built"))
    why = F.when(F.col("built").isNull(), "missing").when(F.col("built") < F.col("written"), "older").when(F.col("stamp") == "", "no stamp")
    return src.join(out, "stem", "left").select("stem", why.alias("why")).where("why is not null")
