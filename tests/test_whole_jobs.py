"""Registered queries do the whole job: small tables against plain Python."""

import hashlib
import math
import random
from collections import Counter

import pytest

from lapidary.operators import evaluation
from lapidary.plans.queries import QUERIES


def test_conformal_over_the_whole_alphabet(spark, records, tmp_path):
    rng = random.Random(5)
    alphabet = [chr(0x13000 + i) for i in range(400)]
    texts = [rng.choices(alphabet, [1 / (i + 1) for i in range(400)], k=rng.randint(1, 4)) for _ in range(500)]
    texts += [[s] for s in alphabet]  # all 400 signs occur
    records([(i, "c", f"d{i}", {"hieroglyphs": "".join(t)}, {}) for i, t in enumerate(texts)]).write.parquet(str(tmp_path / "records.parquet"))
    signs = [list(dict.fromkeys(t)) for t in texts]  # each sign once a record
    counts = Counter(s for t in signs for s in t)
    order, up, cum = sorted(counts, key=lambda s: (-counts[s], s)), 0, {}
    for s in order:
        up += counts[s]
        cum[s] = up / counts.total()
    scores, n = sorted(cum[t[-1]] for t in signs), len(signs)
    k = math.ceil((n + 1) * 0.9)
    qhat = scores[math.ceil(k / n * (n - 1))]
    size = next(i for i, s in enumerate(order, 1) if cum[s] >= qhat - 1e-12)
    hit = sum(t[-1] in order[:size] for t in signs) / n
    got = QUERIES["g21_conformal_threshold"](spark, str(tmp_path)).first()
    assert abs(got["qhat"] - qhat) < 1e-8 and got["n"] == n
    got = QUERIES["g22_conformal_sets"](spark, str(tmp_path)).first()
    assert (got["mean_size"], got["median_size"], got["n"]) == (size, size, n) and size > 200
    assert abs(got["coverage"] - hit) < 1e-8 and hit >= 0.9


def resampled(stats, n_boot=1000, seed=1234):
    """Sums over the picks of each resample: the definition, draw by draw."""
    docs = [v for _, v in sorted(stats.items())]
    pick = lambda b, s: docs[int(hashlib.sha256(f"{seed}|{b}|{s}".encode()).hexdigest()[:8], 16) % len(docs)]
    return [[sum(x) for x in zip(*(pick(b, s) for s in range(len(docs))))] for b in range(n_boot)]


def at(values, p):
    v = sorted(values)
    i = p * (len(v) - 1)
    return v[int(i)] + (v[min(int(i) + 1, len(v) - 1)] - v[int(i)]) * (i - int(i))


@pytest.mark.parametrize("sums", [1 << 20, 5])
def test_bootstrap_of_all_documents(spark, tmp_path, monkeypatch, sums):
    monkeypatch.setattr(evaluation, "SUMS", sums)  # broadcast, and the shuffle past it
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(5, 30), None if i % 5 == 0 else f"s{i % 2}", rng.randint(1, 900)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    v = [s / c for s, c in resampled({i: (n, 1) for i, _, _, n in rows})]
    got = QUERIES["g23_block_bootstrap"](spark, str(tmp_path)).first()
    want = {"point": sum(r[3] for r in rows) / 40, "low": at(v, 0.025), "high": at(v, 0.975), "n_docs": 40}
    assert all(abs(got[k] - x) < 2e-6 for k, x in want.items()), (got, want)
    d = [(a - b) / c for a, b, c in resampled({i: (len(t), len(t) - i % 7 + 3, 1) for i, t, _, _ in rows})]
    obs = sum(i % 7 - 3 for i in range(40)) / 40
    got = QUERIES["g24_paired_bootstrap"](spark, str(tmp_path)).first()
    want = {"delta": obs, "low": at(d, 0.025), "high": at(d, 0.975), "p_value": min(1.0, 2 * sum(x * math.copysign(1, obs) <= 0 for x in d) / 1000)}
    assert all(abs(got[k] - x) < 2e-6 for k, x in want.items()), (got, want)


def test_ledger_lines_by_order_of_batch(spark, tmp_path):
    rows = [("a", 3), ("a", 4), ("b", 4), ("c", 5), ("b", 6), ("d", 6), ("d", 8), ("e", 3), ("e", 7)]
    spark.createDataFrame([(x, "ok", None, b) for x, b in rows], "run_id string, status string, completed_at string, batch_id long").write.parquet(str(tmp_path / "run_records.parquet"))
    seen, new = set(), set()
    for b in sorted({b for _, b in rows}):
        lines = {f"{x}|ok" for x, at_ in rows if at_ == b}
        new |= lines - seen if seen else set()
        seen |= lines
    got = [r[0] for r in QUERIES["d5_new_ledger_lines"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(new) == ["b|ok", "c|ok", "d|ok"]
