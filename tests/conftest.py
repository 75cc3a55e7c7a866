import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lapidary.session import local_session

    s = local_session(4, "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


RECORD = "corpus string, doc_id string, sent_id string, fields map<string,string>, meta map<string,string>, ord long"


@pytest.fixture
def records(spark):
    """Records from rows (ord, corpus, doc_id, fields, meta)."""

    def make(rows, extra=False):
        full = [(c, d, f"s{o}", f, m, o) for o, c, d, f, m in rows]
        df = spark.createDataFrame(full, RECORD)
        if extra:  # columns whose names the operators also use inside
            for c in ("value", "field", "h", "n", "part", "text", "key", "form", "rank"):
                from pyspark.sql import functions as F

                df = df.withColumn(c, F.lit("x"))
        return df

    return make
