"""One very long text among short ones: whole texts are read, beyond the blocks that operators work on."""

import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from hydroseries.llm import edit_embedding, hmm, language_id


@pytest.fixture(scope="module")
def long_text(corpus):
    rng = random.Random(12)
    words = corpus[1][1].split() + corpus[4][1].split()
    return " ".join(rng.choices(words, k=700_000))


def test_language_of_a_long_text(spark, make, corpus, long_text):
    model = language_id.train(make(corpus))
    tail = " ".join(corpus[0][1].split() * 40)
    rows = {r.doc_id: r for r in language_id.label(make([(1, long_text, None, None), (2, f"{long_text} {tail}", None, None), (3, corpus[0][1], None, None)]), model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == "aa" and rows[3].lang_pred == "bb"
    assert rows[2].lang_spans[-1].lang == "bb"  # the end is read too


def test_fingerprint_of_a_long_text(spark, make, long_text):
    rows = make([(1, long_text, None, None), (2, long_text, None, None), (3, "short", None, None)])
    got = {r.doc_id: r for r in edit_embedding.compare_with_edited(rows).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0 and got[1].n_chars == len(long_text)
    want = brute.edited([(1, long_text), (2, long_text), (3, "short")])
    assert {i: r.edited_sha256 for i, r in got.items()} == want


def test_likelihood_of_a_long_text(spark, make, corpus, long_text):
    """Its score is that of the same words at any other length: near the sum over its parts, and finite."""
    part = " ".join(long_text.split()[:2000])
    docs = make([*corpus[:40], (901, long_text, None, None), (902, part, None, None)])
    found = {r.doc_id: r for r in hmm.score(docs, F.col("doc_id") < 900).collect()}
    own, base = found[901], brute.unigram([(901, long_text)])[0][901]
    assert own.n_tokens == base[0] == 700_001 and math.isfinite(own.score)
    assert own.score / own.n_tokens == pytest.approx(found[902].score / found[902].n_tokens, rel=0.02)
