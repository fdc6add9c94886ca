"""Spelling variants against comparing all pairs."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from hydroseries.llm import queries, variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs, least=7, most=31):
    n = collections.Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % most == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= 2}


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain_groups(n, ratio=10):
    """{word: (form, root, n, n_near, form_n)}."""
    words, form, close = sorted(n), {}, {}
    for w in words:
        close[w] = [x for x in words if near(w, x)]
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(close[w]), None if form[w] is None else n[form[w]]) for w in words}


def rows_of(df):
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}
    assert df.count() == len(out)
    return out


def test_variants_of_texts(spark, tmp_path):
    rng = random.Random(1)
    known = ["".join(rng.choices("abcdefghiéß", k=rng.randint(6, 13))) for _ in range(60)]
    docs = [(i, " ".join(rng.choice([str.lower, str.upper, str])(w) for w in rng.choices(known, k=120, weights=range(1, 61)))) for i in range(120)] + [(None, " ".join(known)), (7, "x×y÷zabc ābcdefgh ābcdefgh q" * 3), (8, None), (9, "")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op11_variants(spark, f"file://{tmp_path}")
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_groups(plain_words(docs))
    assert rows_of(df) == want
    assert sum(f is not None for f, *_ in want.values()) > 50 and sum(k for _, _, _, k, _ in want.values()) > 100


@pytest.mark.parametrize("shard,seed", [(1 << 19, 1), (400, 2), (60, 3)])
def test_near_words_equal_all_pairs(spark, monkeypatch, shard, seed):
    """Few letters, so that halves repeat, both halves can be whole, and equal letters stand in a row; hot beginnings are cut into blocks."""
    monkeypatch.setattr(variants, "SHARD", shard)
    rng = random.Random(seed)
    n = {}
    for k in range(500):
        w = "".join(rng.choices("ab" if k % 2 else "abcé", k=rng.randint(7, 10)))
        n[w] = rng.choice([2, 3, 25, 31, 31, 400, 5000])
    for w in list(n)[:100]:
        n.setdefault("aaa" + w, 2)
    long = "ab" * 60
    longer = "".join(rng.choices("ab", k=300))
    n |= {longer: 9, longer[:80] + "x" + longer[81:]: 2, longer[:200] + "x" + longer[201:]: 2, longer[:140] + longer[141:]: 2, longer[:149] + "xx" + longer[151:]: 2, longer[:150] + "x" + longer[150:]: 3, longer[:10] + longer[11:]: 2, "x" + longer: 90, longer + "x": 90}
    n |= {long: 50, long + "b": 3, long[:-1]: 3, "b" + long[1:]: 2, long[:70] + "x" + long[70:]: 4, long[:70] + "yy" + long[70:]: 4}
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long")
    want = plain_groups(n)
    assert rows_of(variants.group_variants(vocabulary)) == want
    assert max(len({r for r in want}), 1) > 400 and sum(r[3] for r in want.values()) > 500


def test_chains_and_ties(spark):
    n = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "zbcdefg": 20, "abcdefx": 20, "standing": 19, "standinh": 2, "standinga": 19}
    out = rows_of(variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert out == plain_groups(n)
    assert out["abcdefg"] == ("abcdefgh", "abcdefghij", 2, 3, 20) and out["standinh"][0] is None
    with pytest.raises(ValueError):
        variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long"), ratio=1)


def test_very_frequent_halves_take_no_square():
    """All words share one half and hardly any are near: hashes meet for near ones only."""
    rng = random.Random(3)
    words = sorted({"common" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(40_000)})
    met, seen = [], variants._meet
    variants._meet = lambda a, b: met.append(len((out := seen(a, b))[0])) or out
    try:
        import numpy as np

        yes, no = np.ones(len(words), bool), np.zeros(len(words), bool)
        variants.search_block(words, np.ones(len(words), int), yes, yes, no)
    finally:
        variants._meet = seen
    assert max(met) < 3 * len(words)


def test_edges(spark, make, none):
    assert variants.count_words(none).count() == 0
    assert variants.group_variants(variants.count_words(none)).count() == 0
    rows = make([(None, None, None, None), (1, "", None, None), (1, "Ordinary ordinary", None, None), (1, "Ordinary ordinary", None, None), (2, "z" * 200_000 + " " + "z" * 200_000, None, None), (3, "word " * 500_000, None, None)]).withColumn("word", F.lit("mine")).withColumn("n", F.lit("n"))
    assert sorted((len(r.word), r.n) for r in variants.count_words(rows).collect()) == [(8, 4), (200_000, 2)]
    assert rows_of(variants.group_variants(variants.count_words(rows)))["ordinary"] == (None, "ordinary", 4, 0, None)
