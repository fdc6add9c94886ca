"""Words and passages: their hashes and the removal of repeats do not depend on where a word or passage stands."""

import os
import random

import brute
import duckdb
import pandas as pd
import pytest

from hydroseries.llm import queries, substring_dedup
from hydroseries.llm.common import FlatWords

SF = "/root/testdata/sf0.01"


def test_hash_is_of_the_word_alone():
    first = FlatWords([b"b"]).hash[0]
    rng = random.Random(1)
    for chunk in (1, 3, 7, 64, 1 << 19):
        texts = [b"x a b", b"a b c", b"", b"a b", b"b", b"\xc3\xa9 b"] + [b" ".join(rng.choices([b"b", b"bb", b"c\xe4", b"b" * 70], k=rng.randint(0, 9))) for _ in range(40)]
        seen = {}
        flat = FlatWords(texts, chunk)
        assert flat.first[-1] == len(flat.hash) == sum(len(t.split()) for t in texts)
        for k in range(len(texts)):
            for i in range(flat.first[k], flat.first[k + 1]):
                seen.setdefault(flat.buffer[flat.start[i] : flat.end[i]], set()).add(int(flat.hash[i]))
        assert all(len(v) == 1 for v in seen.values()) and seen[b"b"] == {int(first)}
        assert len({h for v in seen.values() for h in v}) == len(seen)


def ending_passages(rng, n=40):
    """Texts that end with, begin with or hold one of a few passages, so that equal windows stand at the ends and inside of texts."""
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 4)))
    passages = [[word() for _ in range(rng.randint(13, 30))] for _ in range(5)]
    docs = []
    for i in range(n):
        before, after = ([word() for _ in range(rng.randint(0, 9))] for _ in range(2))
        p = rng.choice(passages)
        docs.append((i, " ".join(rng.choice([before + p, p + after, p, before + p + after, before + p[: rng.randint(12, len(p))]]))))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("block,stretch,frequent", [(1 << 19, 64, 5000), (1, 64, 5000), (40, 2, 5000), (300, 64, 1)])
def test_passages_at_the_end_of_texts(spark, make, monkeypatch, block, stretch, frequent):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    monkeypatch.setattr(substring_dedup, "STRETCH", stretch)
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    docs = ending_passages(random.Random(block + stretch))
    rows = make([(i, t, None, None) for i, t in docs])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(rows.coalesce(2)).collect()}
    want = brute.substring_dedup(docs)
    assert got == want and sum(k for _, k, _ in want.values()) > 300
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(rows).collect()}
    assert {i: " ".join(t.split()) for i, t in left.items()} == {i: kept for i, (_, _, kept) in want.items() if kept}


def test_only_stretches_with_a_repeated_window_are_indexed(spark):
    rng = random.Random(5)
    segs = [" ".join(rng.choices("ab" if k % 3 else "cdefghijkl", k=rng.randint(13, 30))) for k in range(300)]
    windows = [[tuple(s.split(" ")[i : i + 13]) for i in range(len(s.split(" ")) - 12)] for s in segs]
    count = {}
    for w in sum(windows, []):
        count[w] = count.get(w, 0) + 1
    want = [any(count[w] > 1 for w in each) for each in windows]
    assert substring_dedup._repeating(pd.Series(segs), 13).tolist() == want and 30 < sum(want) < 270
    # Where none repeats, the index is empty; stretches that a later document has are told all the same.
    alone = [(k, s, k, k + k % 2) for k, (s, w) in enumerate(zip(segs, want)) if not w]
    told = substring_dedup._matches(spark.createDataFrame(alone, "h long, seg string, least long, most long"), 1, 13).collect()
    assert sorted((r.h, r.seg, r.least, r.begins, r.ends) for r in told) == [(k, s, k, [], []) for k, s, _, most in alone if most > k]


def test_any_blanks_separate_words(make):
    rng = random.Random(9)
    blanks, others = " \t\n\x0b\x0c\r", "\x1c\x85\u00a0\u2003"
    docs = []
    for i in range(60):
        words = [f"w{(i % 4) * 50 + k}{others[k % 4]}" for k in range(rng.choice([5, 14, 20]))]
        glue = lambda most: "".join(rng.choices(blanks, k=rng.randint(1, most)))
        docs.append((i, glue(2)[1:] + "".join(w + glue(1 + i % 3) for w in words)[: -1 if i % 3 == 0 else None]))
    for _, t in docs:
        assert substring_dedup._joined(t) == b" ".join(t.encode().split())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(make([(i, t, None, None) for i, t in docs])).collect()}
    want = brute.substring_dedup(docs)
    assert got == want and sum(k for _, k, _ in want.values()) > 300


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_on_the_larger_tables(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    place = {d[0]: i for i, d in enumerate(want.description)}
    names = sorted(place)
    assert names == sorted(df.columns)
    assert sorted(repr([r[place[n]] for n in names]) for r in want.fetchall()) == sorted(repr([r[n] for n in names]) for r in df.collect())
