"""Command line: ``python -m lapidary.cli <command>``.

ingest CORPUS|all RAW ROOT | census ROOT | split CORPUS SCHEME|all ROOT | freeze CORPUS SCHEME ROOT | verify ROOT |
smoke ROOT | ledger ROOT (report|list|show ID|compact) | recover LOGS CONFIGS LEDGER | gate (sources|reports) FOLDER

``ROOT`` holds ``<corpus>/records`` with ``manifest.json``, ``<corpus>/splits`` with
``_split_info.json`` in each, and ``census``.  ``ingest all`` reads ``RAW/<corpus>``.
The commands return 1 where something failed, is changed, or is not let through.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession

from lapidary.operators import census as C
from lapidary.operators import ledger as L
from lapidary.operators import splits as S
from lapidary.operators.integrity import FrozenError, Store
from lapidary.session import Files, local_session
from lapidary.sources.base import NotIngestable
from lapidary.sources.records import data_version
from lapidary.sources.registry import CORPORA, registry_table


# fixed values: names that load pretrained weights
FORBIDDEN = r"from_pretrained|AutoModel|AutoTokenizer|AutoConfig|torch\.hub|hf_hub_download|snapshot_download|transformers\.pipeline|timm\.create_model"


def _corpus(name: str):
    if name not in CORPORA:
        raise SystemExit(f"unknown corpus {name}; known: {', '.join(sorted(CORPORA))}")
    return CORPORA[name]


def _dump(spark: SparkSession, path: str, what: dict) -> None:
    Files(spark).write(path, json.dumps(what, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def _ingest_one(spark: SparkSession, name: str, raw: str, root: str) -> dict:
    """Records and manifest of one corpus; an inventory has a manifest only."""
    from lapidary.operators.keys import unique_ids
    from lapidary.sources.corpora import read_inventory

    c = _corpus(name)
    about = {k: getattr(c, k) for k in ("kind", "primary_field", "translation_field", "translation_lang")}
    manifest = {"corpus": c.name, **about, "ingested_at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds")}
    if c.kind == "inventory":
        found = {r["subset"]: {k: r[k] for k in ("files", "bytes", "by_extension")} for r in read_inventory(spark, raw).toLocalIterator()}
        manifest |= {"inventory": found, "data_version": "inventory"}
    else:
        unique_ids(c.records(spark, raw)).write.mode("overwrite").parquet(f"{root}/{c.name}/records")
        r = spark.read.parquet(f"{root}/{c.name}/records")
        s = C.ingest_stats(r, registry_table(spark)).first()
        if s is None:
            raise NotIngestable("no records")
        manifest |= {**s.asDict(), "field_coverage": C.coverage_map(r).first()["field_coverage"], "data_version": data_version(r)}
    _dump(spark, f"{root}/{c.name}/manifest.json", manifest)
    return manifest


def ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    failed = 0
    for name in CORPORA if a.corpus == "all" else [a.corpus]:
        try:
            print(json.dumps(_ingest_one(spark, name, f"{a.raw}/{name}" if a.corpus == "all" else a.raw, a.root), ensure_ascii=False, sort_keys=True))
        except NotIngestable as e:
            print(f"[ingest] {name}: {e}", file=sys.stderr)
            failed = 1
    return failed


def data_versions(spark: SparkSession, root: str, names: list[str]) -> str:
    """Versions of several corpora, in order, joined by ``+``."""
    return "+".join(json.loads(Files(spark).read(f"{root}/{n}/manifest.json"))["data_version"] for n in names)


def census(spark: SparkSession, a: argparse.Namespace) -> int:
    """Registry and manifests as a table, on the screen and under ``ROOT/census``."""
    files, rows = Files(spark), []
    for name in CORPORA:
        path = f"{a.root}/{name}/manifest.json"
        if files.exists(path):
            m = json.loads(files.read(path))
            rows.append((name, m.get("n_records"), m.get("n_docs"), m.get("n_tokens_primary"), m["data_version"]))
    table = C.census(registry_table(spark), spark.createDataFrame(rows, "corpus string, n_records long, n_docs long, n_tokens_primary long, data_version string"))
    text = C.census_markdown(table)
    files.write(f"{a.root}/census/census.md", text)
    _dump(spark, f"{a.root}/census/census.json", {r["corpus"]: {k: v for k, v in r.asDict().items() if v is not None} for r in table.toLocalIterator()})  # a row per corpus
    print(text, end="")
    return 0


def split(spark: SparkSession, a: argparse.Namespace) -> int:
    c = _corpus(a.corpus)
    if a.scheme != "all" and a.scheme not in c.schemes:
        raise SystemExit(f"{c.name} has no scheme {a.scheme}; it has: {', '.join(c.schemes) or 'none'}")
    r = spark.read.parquet(f"{a.root}/{c.name}/records")
    for scheme in c.schemes if a.scheme == "all" else [a.scheme]:
        about = {"kind": c.kind, "primary_field": c.primary_field, "translation_field": c.translation_field}
        out, report = S.apply_scheme(scheme, r, about, a.seed, a.dedup_max_norm_dist)
        path = Store(spark, a.root).write(S.check_parts(out), c.name, scheme, a.tag)
        out = spark.read.parquet(path)
        sizes = {x["part"]: x["count"] for x in out.groupBy("part").count().collect()}
        info = {"corpus": c.name, "scheme": scheme, "tag": a.tag, "seed": a.seed, "sizes": sizes, "split_version": S.split_version(out), "report": [x.asDict() for x in report.collect()] if report is not None else []}
        _dump(spark, f"{path}/_split_info.json", info)
        print(json.dumps(info, sort_keys=True))
    return 0


def freeze(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        print(Store(spark, a.root).freeze(a.corpus, a.scheme, a.tag))
        return 0
    except FrozenError as e:
        print(f"[freeze] {e}", file=sys.stderr)
        return 1


def verify(spark: SparkSession, a: argparse.Namespace) -> int:
    bad = Store(spark, a.root).verify()
    print("\n".join(bad) if bad else "all frozen parts are intact")
    return int(bool(bad))


def smoke(spark: SparkSession, a: argparse.Namespace) -> int:
    from lapidary.plans.smoke import run_smoke

    print(json.dumps(run_smoke(spark, a.root), sort_keys=True))
    return 0


def ledger(spark: SparkSession, a: argparse.Namespace) -> int:
    led = L.Ledger(spark, a.root)
    if a.what == "compact":
        print(f"compacted {led.compact()} event(s)")
        return 0
    if not led._has():
        print("the ledger is empty")
        return 0
    if a.what == "report":
        print(L.format_report(led.runs().withColumn("value", L.metric("all_metrics", "selection_metric"))), end="")
    elif a.what == "list":
        for r in L.list_runs(led.runs(), a.family, a.phase, a.status).orderBy("run_id").toLocalIterator():
            print(r["run_id"], r["family"], r["status"], sep="\t")
    else:
        try:
            print(json.dumps(L.show_run(led.runs(), a.run_id), sort_keys=True))
        except L.LedgerError as e:
            print(e, file=sys.stderr)
            return 1
    return 0


def recover(spark: SparkSession, a: argparse.Namespace) -> int:
    """Runs that finished but are not in the ledger; with ``--apply`` they are written to it."""
    from lapidary.sources.config import read_configs
    from lapidary.sources.logs import read_logs

    lost = L.reconstruct(L.Ledger(spark, a.ledger), read_logs(spark, a.logs), read_configs(spark, a.configs), a.apply)
    print("\n".join(lost) if lost else "no run is missing")
    return 0


def gate(spark: SparkSession, a: argparse.Namespace) -> int:
    from lapidary.sources import logs

    found = logs.forbidden_lines(spark, a.folder, a.pattern, exclude=a.exclude) if a.what == "sources" else logs.stale_reports(spark, a.folder)
    rows = [" ".join(map(str, r)) for r in found.toLocalIterator()]
    print("\n".join(rows) if rows else "clean")
    return int(bool(rows))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lapidary", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for x in args:
            s.add_argument(x)
        return s

    add("ingest", "corpus", "raw", "root")
    add("census", "root")
    add("verify", "root")
    add("smoke", "root")
    for name in ("split", "freeze"):
        s = add(name, "corpus", "scheme", "root")
        s.add_argument("--tag", default="v1")
        s.add_argument("--seed", type=int, default=1337)
        s.add_argument("--dedup-max-norm-dist", type=float, default=0.1, help="0: exact copies only")
    add("recover", "logs", "configs", "ledger").add_argument("--apply", action="store_true")
    s = add("gate", "what", "folder")
    s.add_argument("--pattern", default=FORBIDDEN)
    s.add_argument("--exclude", default="contrib/openbook")
    s = add("ledger", "root", "what")
    s.add_argument("run_id", nargs="?")
    for x in ("family", "phase", "status"):
        s.add_argument(f"--{x}")
    a = p.parse_args(argv)
    return globals()[a.command](spark or local_session(), a)


if __name__ == "__main__":
    raise SystemExit(main())
