"""Importance resampling against a plain version."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroseries.llm import importance, queries

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def plain(docs, targets):
    """docs: (id, text), unique ids; {id: (features, weight, score, rank)}."""
    of = {i: features(t) for i, t in docs}
    s, t = collections.Counter(), collections.Counter()
    for _, f in of.values():
        s.update(f)
    for x in targets:
        t.update(features(x)[1])
    above, below = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * above / ((s[b] + 1) * below)))
    rows = {}
    for i, (n, f) in of.items():
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows[i] = (n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    order = sorted((i for i, r in rows.items() if r[0] >= 20), key=lambda i: (-rows[i][3], i))
    rank = {i: k for k, i in enumerate(order[: 25 * len(order) // 100], 1)}
    return {i: (*r[1:], rank.get(i)) for i, r in rows.items()}


def rows_of(df):
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()}


def test_draw_equals_plain_version(spark, corpus, corpus_dir):
    rng = random.Random(5)
    targets = [" ".join(rng.choices((corpus[k][1] or "x").split() or ["y"], k=30)) for k in range(0, 50, 3)] + [None, ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string").write.parquet(f"{corpus_dir}/benchmark.parquet")
    df = queries.op13_importance(spark, corpus_dir)
    want = plain([(i, t) for i, t, _, _ in corpus], targets)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in df.dtypes} == {"bigint"}
    assert rows_of(df) == want and df.count() == len(want)
    assert sum(r[3] is not None for r in want.values()) > 15


@pytest.mark.parametrize("order", [1, 2, 4])
def test_ring_is_of_all_runs(order):
    rng = random.Random(order)
    for part in (1, 5, 1 << 16):
        text = "".join(rng.choices(["a", "B", "é", "ß", " ", "\n", "-", "9", "中", "\x00"], k=400))
        w = WORDS.findall(text.translate(LOWER))
        want = sorted(zlib.crc32(" ".join(w[i : i + n]).encode()) % 97 for n in range(1, order + 1) for i in range(len(w) - n + 1))
        n, got = importance.ring_buckets(text.encode(), order, 97, part)
        assert n == len(w) and sorted(got.tolist()) == want


def test_target_like_documents_are_drawn(spark):
    rng = random.Random(9)
    kinds = [[f"{k}{i}" for i in range(50)] for k in "xy"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(kinds[i % 5 == 0], k=60)), i) for i in range(200)], "doc_id long, text string, rank long")
    targets = spark.createDataFrame([(" ".join(rng.choices(kinds[1], k=500)),)], "text string")
    drawn = importance.resample(docs, targets, share=20)
    got = [r.doc_id for r in drawn.collect()]
    assert drawn.columns == docs.columns and len(got) == 40 and sum(i % 5 == 0 for i in got) >= 20  # eight by chance


def test_ranks_are_global(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("score"), F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id") % 100).alias("doc_id")).repartition(7)
    out, n = importance.ranked(rows, F.desc("score"), F.asc_nulls_last("doc_id"))
    got = sorted(out.collect(), key=lambda r: r["rank"])
    assert n == 5000 and [r["rank"] for r in got] == list(range(1, 5001))
    order = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in got]
    assert order == sorted(order)


def test_edges(spark, make, none):
    targets = spark.createDataFrame([("one two three",)], "text string")
    assert importance.draw(none.select("doc_id", "text"), targets).count() == 0 and importance.resample(none, targets).count() == 0
    long = "word " * 400_000
    rows = make([(None, "a " * 25, None, None), (None, "a " * 25, None, None), (1, None, None, None), (2, "", None, None), (3, " .!? ", None, None), (4, long, None, None), (5, "b " * 19, None, None), (5, "b " * 20, None, None)])
    for wanted in (targets, targets.limit(0)):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_features, r.weight == 0, r["rank"] is None) for r in importance.draw(rows.select("doc_id", "text"), wanted, share=100).collect())
        assert [g[:4] for g in got] == [(False, 1, 0, 0), (False, 2, 0, 0), (False, 3, 0, 0), (False, 4, 400_000, 799_999), (False, 5, 19, 37), (False, 5, 20, 39), (True, 0, 25, 49), (True, 0, 25, 49)]
        assert [g[5] for g in got] == [True, True, True, False, True, False, False, False]
    clash = rows.withColumn("buckets", F.lit("mine")).withColumn("_at", F.lit(1)).withColumn("weight", F.lit("w"))
    kept = importance.resample(clash, targets, share=100)
    assert kept.columns == clash.columns and sorted((r.doc_id or 0, r.buckets, r.weight) for r in kept.collect()) == [(0, "mine", "w"), (0, "mine", "w"), (4, "mine", "w"), (5, "mine", "w")]
    assert np.array_equal(importance.gains(np.zeros(3, np.int64), np.zeros(3, np.int64)), np.zeros(3))
