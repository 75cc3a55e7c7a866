"""Configuration files: YAML mappings, deep merge, strict keys."""

from __future__ import annotations

import dataclasses
from pathlib import Path
from typing import Any, TypeVar

import yaml

T = TypeVar("T")


def load_yaml(path: str | Path) -> dict[str, Any]:
    """The mapping of a file; an empty file is an empty mapping, anything else an error."""
    got = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if got is None:
        return {}
    if not isinstance(got, dict):
        raise ValueError(f"{path}: the top level must be a mapping")
    return got


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """``over`` on ``base``, mapping by mapping."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def build(cls: type[T], values: dict[str, Any]) -> T:
    """A dataclass from a mapping; unknown keys are an error."""
    known = {f.name for f in dataclasses.fields(cls)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown keys for {cls.__name__}: {', '.join(unknown)}")
    return cls(**values)


def check_seeds(seeds: list[int], least: int = 3) -> list[int]:
    """Distinct integers, ``least`` or more."""
    if any(isinstance(s, bool) or not isinstance(s, int) for s in seeds) or len(set(seeds)) != len(seeds) or len(seeds) < least:
        raise ValueError(f"needs {least} or more distinct integer seeds")
    return seeds


def read_configs(spark, root: str):
    """``(run_id, family, hypothesis, seed, config_hash, data_version, split_version)`` of the YAML files below ``root``, a folder per run."""
    from lapidary.functions.hashing import config_hash
    from lapidary.sources.base import whole_files

    names = ("family", "hypothesis", "data_version", "split_version")

    def parse(parts):
        import pandas as pd

        for pdf in parts:
            rows = []
            for rel, raw in zip(pdf["rel"], pdf["content"]):
                c = yaml.safe_load(bytes(raw)) or {}
                run = rel.split("/")[-2] if "/" in rel else rel.rsplit(".", 1)[0]
                rows.append((run, *(None if c.get(k) is None else str(c[k]) for k in names), c.get("seed"), config_hash(c)))
            yield pd.DataFrame(rows, columns=["run_id", *names, "seed", "config_hash"]).astype({"seed": "Int64"})

    return whole_files(spark, root, "*.yaml").mapInPandas(parse, ", ".join(["run_id string", *(f"{n} string" for n in names), "seed long", "config_hash string"]))
