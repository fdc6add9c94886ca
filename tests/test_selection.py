"""Percentiles by distributed selection against the built-in ones, which hold a group in a task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroseries.operators import selection

SHARES = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.9, "q10": 1.0}


def built_in(rows, keys):
    return rows.where("abs(v) < double('inf')").groupBy(*keys).agg(*[F.percentile("v", q).alias(n) for n, q in SHARES.items()], F.count("v").alias("n"))


def told(df, keys):
    return sorted(repr([r[k] for k in keys] + [r[n] for n in (*SHARES, "n")]) for r in df.collect())


@pytest.mark.parametrize("held,bins", [(10_000, 1024), (20, 16)])
def test_equal_to_the_built_in(spark, held, bins):
    rng = random.Random(held)
    rows = []
    for key in ["even", "ties", "steep", "one", None, "pair", "huge"]:
        n = {"one": 1, "pair": 2, "huge": 50}.get(key, 300)
        for i in range(n):
            v = {"even": rng.random(), "ties": float(rng.choice([1, 2, 2, 2, 9])), "steep": 10.0 ** rng.randint(-300, 300), "huge": rng.choice([-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324])}.get(key, rng.gauss(0, 5))
            rows.append((key, i % 2, v))
    rows += [("even", 0, None), ("even", 0, float("nan")), ("even", 1, float("inf")), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(3)
    for keys in (["k"], ["k", "j"])[: 2 if held > 100 else 1]:
        got = selection.percentiles(df, keys, F.col("v"), SHARES, count="n", held=held, bins=bins)
        assert got.columns == [*keys, *SHARES, "n"] and told(got, keys) == told(built_in(df, keys), keys)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert selection.percentiles(df, ["k"], F.col("v"), SHARES).count() == 0


def test_two_million_rows_of_one_key(spark, monkeypatch):
    """No range that reaches the last step, where values stand in one task, holds more than HELD values; and no task reads a whole group before."""
    n = 2_000_000
    df = spark.range(0, n, 1, 8).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    written, write = [], selection.write_shared
    monkeypatch.setattr(selection, "write_shared", lambda d, name: written.append(write(d, name)) or written[-1])
    got = selection.percentiles(df, ["k"], F.col("v"), {"q1": 0.25, "q2": 0.5, "q3": 0.75}, count="n")
    last = written[-1].collect()
    assert len(written) >= 2 and max(r["size"] for r in last) <= selection.HELD and sum(r["size"] for r in last) < 8 * n / selection.BINS
    row = got.first()
    assert (row.q1, row.q2, row.q3, row.n) == (*np.percentile(np.arange(n), [25, 50, 75]).tolist(), n)


def test_beside_meets_null_keys(spark):
    rows = spark.createDataFrame([("a", 1, 2), (None, 1, 3), ("c", 1, 4)], "k string, j int, x int")
    figures = spark.createDataFrame([("a", 1, 10), (None, 1, 20)], "k string, j int, y int")
    assert sorted((r.x, r.y) for r in selection.beside(rows, figures, ["k", "j"]).collect()) == [(2, 10), (3, 20)]
    assert selection.beside(rows, figures, ["k", "j"], "left").columns == ["k", "j", "x", "y"]
    assert selection.beside(rows, figures, ["k", "j"], "left_semi").count() == 2
