"""Session and shared storage.

Lineage is cut by writing a table to the folder all executors share, which the
session names in ``spark.checkpoint.dir``.  A machine-local folder is used only
where that setting is absent, as in tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cores: int = 8, app: str = "lapidary") -> SparkSession:
    """A local session with the settings the engine is tuned for."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per application, for workers that cannot import it from their own path."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="lapidary-code-")  # on the driver; Spark distributes the file
        with zipfile.ZipFile(f"{folder}/lapidary_code.zip", "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        sc.addPyFile(f"{folder}/lapidary_code.zip")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder of this application under the shared checkpoint folder."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _roots:
        base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not base and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if not base:
            base = tempfile.mkdtemp(prefix="lapidary-")
            sc.setCheckpointDir(base)
        root = f"{base.rstrip('/')}/stage-{uuid.uuid4().hex[:12]}"
        _roots[app] = root
        atexit.register(_remove, spark, root)
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:
        pass  # the session is gone; the folder belongs to the cluster's own clean-up


class Files:
    """Small files (manifests, ledger events) on whatever file system a path names, through Hadoop's interface."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def list(self, path: str, ending: str = ".jsonl") -> list[str]:
        fs, p = self._at(path)
        found = [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [f for f in found if f.endswith(ending)]

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        f = fs.open(p)
        try:
            return bytes(f.readAllBytes()).decode("utf-8")
        finally:
            f.close()

    def write(self, path: str, text: str) -> None:
        """Replace the file as a whole: written beside it, forced to disk, renamed into place."""
        fs, p = self._at(path)
        tmp = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex[:8]}")
        f = fs.create(tmp, True)
        try:
            f.write(text.encode("utf-8"))
            f.hsync()
        finally:
            f.close()
        if not fs.rename(tmp, p):  # a store whose rename does not replace
            fs.delete(p, False)
            if not fs.rename(tmp, p):
                raise OSError(f"cannot write {path}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    The result has no lineage beyond the files, so a lost executor costs only
    the tasks that ran on it.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a staged table that is no longer needed."""
    root = _roots.get(df.sparkSession.sparkContext.applicationId)
    for f in df.inputFiles()[:1]:
        folder = f.rsplit("/", 1)[0]
        if root and root.split(":")[-1].lstrip("/") in folder:
            _remove(df.sparkSession, folder)


def ranked_within(df: DataFrame, groups: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Exact 0-based rank of each row within its group, without a task per group.

    A window over the group would put a hot group into one task.  Instead the
    rows are range-partitioned by (groups, order), so a hot group spreads over
    several partitions; each partition numbers its rows, and the offsets of the
    (group, partition) runs, at most groups + partitions of them, are summed.
    ``groups`` may be empty (a global rank).  ``order`` must be total for a
    reproducible result; ties are numbered in any order.  Nulls form one group.
    """
    keys = [*groups, *order]
    at = "__rw_at"
    rows = stage(
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn(at, F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright(F.col(at), 33)
    runs = rows.groupBy(*groups, part.alias("__rw_p")).agg(F.min(at).alias("__rw_first"), F.count("*").alias("__rw_n"))
    # few rows: groups + partitions; an expanding sum per group
    from pyspark.sql import Window as W

    w = W.partitionBy(*groups).orderBy("__rw_p").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("__rw_off", F.coalesce(F.sum("__rw_n").over(w), F.lit(0)))
    left, right = rows.withColumn("__rw_p", part), runs.select(
        *[F.col(g).alias(f"__rw_g{i}") for i, g in enumerate(groups)], F.col("__rw_p").alias("__rw_q"), "__rw_first", "__rw_off"
    )
    cond = F.col("__rw_p") == F.col("__rw_q")
    for i, g in enumerate(groups):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__rw_g{i}"))
    out = left.join(right, cond).withColumn(name, F.col(at) - F.col("__rw_first") + F.col("__rw_off"))
    return out.select(*df.columns, name)


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum in a global order: per range partition, plus the sums of the partitions before."""
    from pyspark.sql import Window as W

    rows = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "running")
    rows = rows.withColumn("__p", F.shiftright("__at", 33))
    blocks = rows.groupBy("__p").agg(F.sum(value).alias("__s"))
    before = blocks.select("__p", F.coalesce(F.sum("__s").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inner = F.sum(value).over(W.partitionBy("__p").orderBy("__at").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__in", inner).join(before, "__p").withColumn(name, F.col("__in") + F.col("__b")).select(*df.columns, name)
