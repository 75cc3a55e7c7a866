"""Frozen test sets, audited reads and path guards."""

from __future__ import annotations

import datetime as dt
import json
import os
import traceback
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.functions.hashing import content_hash
from lapidary.session import Files

_run: list[str] = []


class FrozenError(RuntimeError):
    """A frozen part changed, is missing, or would be written."""


@contextmanager
def run_context(run_id: str):
    """Reads inside carry this run id in the audit log."""
    _run.append(run_id)
    try:
        yield
    finally:
        _run.pop()


def current_run() -> str | None:
    return _run[-1] if _run else None


def inside_test(path: str, root: str | None = None) -> bool:
    """The path lies below a ``test`` folder of the data root (or behind its first ``data`` component), or its name starts with ``test.``.

    ``part=test`` is a test folder too.
    """
    p = os.path.abspath(os.path.expanduser(path.removeprefix("file://")))
    if root and (p + "/").startswith(os.path.abspath(root).rstrip("/") + "/"):
        below = os.path.relpath(p, os.path.abspath(root)).split("/")
    else:
        parts = p.split("/")
        if "data" not in parts:
            return False
        below = parts[parts.index("data") + 1 :]
    below = [x for x in below if x not in ("", ".")]
    return bool(below) and (any(x in ("test", "part=test") for x in below[:-1]) or below[-1].startswith("test.") or below[-1] == "part=test")


class Store:
    """Splits under a root folder, with a manifest of frozen digests and an audit log."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files, self.manifest_path, self.audit_path = Files(spark), f"{self.root}/frozen.json", f"{self.root}/audit"

    def path(self, corpus: str, scheme: str, tag: str) -> str:
        return f"{self.root}/{corpus}/splits/{scheme}/{tag}"

    def key(self, corpus: str, scheme: str, tag: str) -> str:
        return f"{corpus}/{scheme}/{tag}/test"

    def manifest(self) -> dict:
        return json.loads(self.files.read(self.manifest_path)) if self.files.exists(self.manifest_path) else {}

    def write(self, split: DataFrame, corpus: str, scheme: str, tag: str = "v1") -> str:
        """Write a split by part; refused where its test part is frozen."""
        if self.key(corpus, scheme, tag) in self.manifest():
            raise FrozenError(f"{self.key(corpus, scheme, tag)} is frozen")
        p = self.path(corpus, scheme, tag)
        split.write.mode("overwrite").partitionBy("part").parquet(p)
        return p

    def _part(self, corpus: str, scheme: str, tag: str, part: str) -> DataFrame:
        return self.spark.read.parquet(self.path(corpus, scheme, tag)).where(F.col("part") == part).drop("part")

    def freeze(self, corpus: str, scheme: str, tag: str = "v1") -> str:
        """Record the content digest of the test part; again with the same content is fine, with another is an error."""
        k, m = self.key(corpus, scheme, tag), self.manifest()
        test = self._part(corpus, scheme, tag, "test")
        h = content_hash(test)
        if k in m:
            if m[k]["sha256"] != h:
                raise FrozenError(f"{k} differs from what was frozen")
            return h
        m[k] = {"sha256": h, "frozen_at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds"), "n_rows": test.count()}
        self.files.write(self.manifest_path, json.dumps(m, indent=2, sort_keys=True) + "\n")
        return h

    def read(self, corpus: str, scheme: str, tag: str = "v1", part: str = "train") -> DataFrame:
        """The only way to a part: a read of a test part is checked against the manifest and logged."""
        df = self._part(corpus, scheme, tag, part)
        if part == "test":
            k = self.key(corpus, scheme, tag)
            want = self.manifest().get(k)
            if want and content_hash(df) != want["sha256"]:
                raise FrozenError(f"{k} was changed")
            self._log(k, "read")
        return df

    def verify(self) -> list[str]:
        """What is wrong with the frozen parts: ``missing …`` or ``changed …``."""
        out = []
        for k, want in sorted(self.manifest().items()):
            corpus, scheme, tag, _ = k.split("/")
            try:
                if content_hash(self._part(corpus, scheme, tag, "test")) != want["sha256"]:
                    out.append(f"changed {k}")
            except Exception:
                out.append(f"missing {k}")
        return out

    def _log(self, key: str, mode: str) -> None:
        frame = next((f for f in reversed(traceback.extract_stack()[:-1]) if f.filename != __file__), None)
        event = {
            "timestamp": dt.datetime.now(dt.UTC).isoformat(timespec="seconds"), "run_id": current_run(), "path": key, "mode": mode, "pid": os.getpid(),
            "caller": f"{frame.filename}:{frame.lineno}" if frame else None,
        }
        self.files.write(f"{self.audit_path}/{uuid.uuid4().hex}.jsonl", json.dumps(event) + "\n")

    def audit(self) -> DataFrame:
        schema = "timestamp string, run_id string, path string, mode string, pid long, caller string"
        if not self.files.exists(self.audit_path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(self.audit_path)
