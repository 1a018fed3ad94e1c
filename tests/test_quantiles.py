import math

import numpy as np
import pytest

from skeinwork.operators.quantiles import grouped_quantiles

PROBS = (0, 0.25, 0.5, 0.9, 1)


def brute(rows, probs=PROBS):
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    out = {}
    for k, vs in groups.items():
        xs = sorted(v for v in vs if v is not None)
        out[k] = (len(vs), len(xs), [xs[max(1, math.ceil(p * len(xs) - 1e-9)) - 1] if xs else None for p in probs])
    return out


@pytest.mark.parametrize("kind", ["small", "wide", "negative", "double"])
def test_against_sorting(spark, kind):
    rng = np.random.default_rng(5)
    n = 4000
    values = {"small": rng.integers(0, 40, n), "wide": rng.integers(0, 2**55, n), "negative": rng.integers(-(10**9), 10**9, n), "double": rng.normal(size=n) * 10.0 ** rng.integers(-9, 9, n)}[kind].tolist()
    # one key has nine tenths of the rows
    keys = ["hot" if x < 0.9 else f"k{int(x * 1000) % 17}" for x in rng.random(n)]
    rows = [(k, None if i % 97 == 0 else v) for i, (k, v) in enumerate(zip(keys, values, strict=True))]
    df = spark.createDataFrame(rows, f"word string, x {'double' if kind == 'double' else 'long'}")
    got = {r.key: (r.n_rows, r.n_values, list(r.quantiles)) for r in grouped_quantiles(df, "word", "x", PROBS).collect()}
    assert got == brute(rows)


def test_edge_cases(spark):
    rows = [(None, 3), (None, 1), ("a", None), ("b", 7), ("b", 7), ("b", 7), ("min", -(2**63)), ("min", 2**63 - 1)]
    df = spark.createDataFrame([(k, v, 0, "c") for k, v in rows], "key string, v long, c int, q string")
    got = {r.key: (r.n_rows, r.n_values, list(r.quantiles)) for r in grouped_quantiles(df.where("key IS NULL OR key <> 'min'"), "key", "v", PROBS).collect()}
    assert got == brute([r for r in rows if r[0] != "min"])
    assert grouped_quantiles(df.limit(0), "key", "v", PROBS).count() == 0
    assert [list(r.quantiles) for r in grouped_quantiles(df.where("key = 'a'"), "key", "v", PROBS).collect()] == [[None] * 5]
    with pytest.raises(ValueError):
        grouped_quantiles(df, "key", "v", [2])


def test_extreme_integers(spark):
    rows = [("min", -(2**63)), ("min", 2**63 - 1), ("min", 0), ("min", -5)]
    df = spark.createDataFrame(rows, "key string, v long")
    got = {r.key: list(r.quantiles) for r in grouped_quantiles(df, "key", "v", PROBS).collect()}
    assert got == {"min": brute(rows)["min"][2]}


def test_special_doubles(spark):
    df = spark.createDataFrame([("a", float("inf")), ("a", -0.0), ("a", 0.0), ("a", float("-inf"))], "key string, v double")
    assert list(grouped_quantiles(df, "key", "v", (0, 0.5, 1)).first().quantiles) == [float("-inf"), 0.0, float("inf")]


def test_buckets_are_spread_by_their_values(spark, monkeypatch):
    from skeinwork.operators import quantiles

    monkeypatch.setattr(quantiles, "PIECE", 50)
    rng = np.random.default_rng(8)
    rows = [("hot" if i % 10 else None, float(x)) for i, x in enumerate(rng.normal(1e6, 3, 5000))]
    df = spark.createDataFrame(rows, "word string, x double")
    got = {r.key: (r.n_rows, r.n_values, list(r.quantiles)) for r in grouped_quantiles(df, "word", "x", PROBS).collect()}
    assert got == brute(rows)
