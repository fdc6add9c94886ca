import hashlib
import os
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroseries.llm import edit_embedding, hmm, language_id, piece_lattice, queries, simhash, substring_dedup
from hydroseries.llm.fm_index import FmIndex


def by_id(df, *names):
    return {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}


# Language identification.


def test_language_of_held_out_texts(spark, corpus, corpus_dir):
    got = by_id(queries.op1_language_id(spark, corpus_dir), "held_out", "lang_pred", "score")
    assert len(got) == len(corpus)
    right = [got[i][1] == lang for i, text, lang, _ in corpus if text and lang and len(text.split()) > 4 and got[i][0]]
    assert len(right) > 10 and sum(right) / len(right) > 0.95
    assert got[90][1:] == got[91][1:] == got[97][1:] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, _, s in got.values())


def test_mixed_text_has_spans(spark, corpus, make):
    model = language_id.train(make(corpus))
    a, b = corpus[1][1].split()[:40], corpus[0][1].split()[:40]
    row = language_id.label(make([(1, " ".join(a + b), None, None)]), model).first()
    assert [s.lang for s in row.lang_spans] == ["aa", "bb"] and abs(row.lang_spans[0].n_words - len(a)) <= 2


def test_viterbi_shortcut_equals_full_decoding():
    rng = np.random.default_rng(0)
    model = language_id.LanguageModel(("a", "b", "c"), np.zeros((1, 3), np.float32), np.ones((1, 3), bool), 3.0)
    for _ in range(200):
        s = rng.normal(0, rng.choice([0.3, 1, 3]), (rng.integers(1, 12), 3))
        got = model.path(s)
        cost = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best, v = None, s[0]
        v = {k: s[0, k] for k in range(3)}
        for row in s[1:]:
            v = {k: max(v[j] - 3.0 * (j != k) for j in v) + row[k] for k in v}
        best = max(v.values())
        assert cost(got) == pytest.approx(best)


def test_language_edges(spark, make, none, corpus):
    empty = language_id.train(none)
    assert language_id.label(none, empty).count() == 0
    row = language_id.label(make([(1, "some words", None, None)]), empty).first()
    assert (row.lang_pred, row.lang_score, row.lang_spans) == ("und", 0.0, [])
    model = language_id.train(make(corpus))
    clash = language_id.label(make([(1, "Ελληνικά", None, None), (1, "Ελληνικά", None, None)]).withColumn("LANG_PRED", F.lit(1)), model)
    assert clash.columns.count("lang_pred") == 1 and clash.count() == 2 and clash.first().lang_pred in ("aa", "bb")


def plain_language(train, texts, switch=12.0):
    """Trigram scores, scripts, and Viterbi by plain loops; the trigrams' buckets are the operator's."""
    import math
    import unicodedata

    def words(text):
        out, at = [], 0
        inside = lambda c: c.isalpha() or unicodedata.category(c)[0] == "M" or c in "\u200c\u200d"
        while at < len(text):
            end = at
            while end < len(text) and inside(text[end]):
                end += 1
            if end > at and any(c.isalpha() for c in text[at:end]):
                out.append(text[at:end])
            at = max(end, at + 1)
        return out

    def low(c):
        return c.lower() if c.isalpha() and len(c.lower()) == 1 else c

    def trigrams(word):
        w = [0, *[ord(low(c)) for c in word], 0]
        m = (1 << 64) - 1
        for a, b, c in zip(w, w[1:], w[2:], strict=False):
            h = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) & m
            h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & m
            yield (h >> 40) % language_id.BUCKETS

    script = lambda w: next((n for n, r in language_id.SCRIPTS.items() if any(a <= ord(w[0]) <= b for a, b in r)), None)
    langs = sorted({x for _, x in train})
    n = {x: {} for x in langs}
    used = {x: {} for x in langs}
    for text, x in train:
        for w in words(text):
            used[x][script(w)] = used[x].get(script(w), 0) + len(w)
            for t in trigrams(w):
                n[x][t] = n[x].get(t, 0) + 1
    total = {x: sum(n[x].values()) + 0.5 * language_id.BUCKETS for x in langs}
    allowed = {x: {s for s, k in used[x].items() if k > 0.001 * sum(used[x].values())} for x in langs}
    known = set().union(*allowed.values())
    out = []
    for text in texts:
        ws = words(text)
        score = [[sum(math.log((n[x].get(t, 0) + 0.5) / total[x]) for t in trigrams(w)) + (0 if script(w) in allowed[x] or script(w) not in known else -40.0 * len(w)) for x in langs] for w in ws]
        if not ws:
            out.append("und")
            continue
        v, back = list(score[0]), []
        for row in score[1:]:
            come = [max(range(len(langs)), key=lambda j, k=k: (v[j] - switch * (j != k), -j)) for k in range(len(langs))]
            v = [v[come[k]] - switch * (come[k] != k) + row[k] for k in range(len(langs))]
            back.append(come)
        path = [max(range(len(langs)), key=lambda k: (v[k], -k))]
        for come in reversed(back):
            path.append(come[path[-1]])
        share = [sum(len(w) for w, k in zip(ws, reversed(path), strict=True) if k == j) for j in range(len(langs))]
        out.append(langs[max(range(len(langs)), key=lambda k: (share[k], -k))])
    return out


def test_labels_equal_plain_version(spark, corpus, make):
    rows = [r for r in corpus if r[0] < 60]
    model = language_id.train(make(rows))
    texts = [t for _, t, _, _ in corpus if t and len(t) < 5000] + ["नमस्ते दुनिया", "abc déf ж", "ab1cd", "a\u0301b"]
    want = plain_language([(t, x) for _, t, x, _ in rows if t and x], texts)
    assert [x[0] for x in model.label(texts)] == want


def test_marks_are_part_of_words():
    for text, n in (("नमस्ते सुंदर दुनिया", 3), ("আমার সোনার বাংলা", 3), ("வணக்கம் உலகம்", 2), ("నమస్కారం ప్రపంచం", 2), ("สวัสดี ชาวโลก", 2), ("می\u200cخواهم برو", 2), ("e\u0301te\u0301 \u0301 a", 2), ("\u0301\u0302", 0)):
        assert len(language_id.words_of([text], 1 << 16).start) == n, text


def test_equal_scores_go_to_the_first_name(spark, make):
    model = language_id.train(make([(1, "same words", "zz", None), (2, "same words", "aa", None)]))
    assert model.label(["same words"])[0][0] == "aa"


# Fingerprints.


def plain_fingerprint(text):
    """The walk character by character, its steps one by one."""
    rng = np.random.default_rng(20240601)
    bits = rng.integers(0, 2, (251, 1024), dtype=np.int64)
    bits[:, -1] |= bits.sum(1) == 0
    at = t = 0
    stood = []
    while at < len(text):
        stood.append(ord(text[at]))
        at += int(bits[ord(text[at]) % 251, t % 1024])
        t += 1
    if not stood:
        return "0" * 64
    top, chain = np.full(256, float(1 << 40)), []
    for _ in range(96):
        top = np.floor(rng.random(256) * top)
        chain.append(top.astype(int))
    m, out = (1 << 64) - 1, []
    for slot in range(256):
        step = next(int(c[slot]) for c in chain if c[slot] < len(stood))
        h = stood[step] * 256 + slot
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & m
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & m
        out.append((h ^ h >> 31) >> 33 & 1)
    return np.packbits(np.array(out, np.uint8)).tobytes().hex()


def test_fingerprints_and_likeness_equal_plain_version(spark, corpus, corpus_dir):
    rows = sorted([(i, t or "") for i, t, _, _ in corpus], reverse=True)
    got = {r.doc_id: r for r in queries.op2_edit_embedding(spark, corpus_dir).collect()}
    like = lambda a, b: max(0.0, 2 * (256 - bin(int(a, 16) ^ int(b, 16)).count("1")) / 256 - 1)
    for k, (i, text) in enumerate(rows):
        following, n = rows[(k + 1) % len(rows)][1], len(text) // 3
        own, new = plain_fingerprint(text), plain_fingerprint(text[: len(text) - n] + following[:n])
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own, new)
        assert got[i].near_edited == pytest.approx(like(own, new)) and got[i].near_next == pytest.approx(like(own, plain_fingerprint(following)))


def test_edited_texts_and_likeness(spark, corpus, corpus_dir):
    got = {r.doc_id: r for r in queries.op2_edit_embedding(spark, corpus_dir).collect()}
    want = brute.edited([(i, t) for i, t, _, _ in corpus])
    assert {i: r.edited_sha256 for i, r in got.items()} == want
    assert all(got[i].n_chars == len(t or "") for i, t, _, _ in corpus)
    texts = {}
    for i, t, _, _ in corpus:
        assert texts.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    long = [r for r in got.values() if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > 0.55 and all(0 <= r.near_next <= 1 for r in got.values())
    assert np.mean([r.near_edited for r in long if r.near_next < 0.5]) > np.mean([r.near_next for r in long if r.near_next < 0.5]) + 0.3
    assert {len(r.fingerprint) for r in got.values()} == {64}


def test_walks_meet_again_after_an_edit():
    rng = random.Random(1)
    near, far = [], []
    for _ in range(20):
        t = "".join(rng.choices("abcdefgh ", k=800))
        at = rng.randrange(800)
        near.append(edit_embedding.likeness(edit_embedding.Text(t).bits, edit_embedding.Text(t[:at] + "x" + t[at:]).bits))
        far.append(edit_embedding.likeness(edit_embedding.Text(t).bits, edit_embedding.Text("".join(rng.choices("abcdefgh ", k=800))).bits))
    assert np.mean(near) > 0.7 > 0.4 > np.mean(far)


def test_fingerprint_edges(spark, make, none):
    assert edit_embedding.compare_with_edited(none).count() == 0
    one = edit_embedding.compare_with_edited(make([(None, "abcdef", None, None)])).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    rows = edit_embedding.compare_with_edited(make([(1, "abc", None, None), (1, "abc", None, None), (None, None, None, None), (None, None, None, None), (2, "xyz", None, None)]).withColumn("bucket", F.lit(1)), buckets=3).collect()
    assert len(rows) == 5 and sum(r.n_chars == 0 for r in rows) == 2


def test_near_copies_share_bands(spark, make):
    rng = random.Random(5)
    t = "".join(rng.choices("abcdefgh ", k=500))
    other = "".join("y" if i % 45 == 7 else c for i, c in enumerate(t))
    near, far = edit_embedding.Text(other).bits, edit_embedding.Text("".join(rng.choices("abcdefgh ", k=500))).bits
    keys = [edit_embedding.band_keys(b, 24, 16) for b in (edit_embedding.Text(t).bits, near, far)]
    assert (keys[0] == keys[1]).any() and not (keys[0] == keys[2]).any()
    rows = make([(1, t, None, None), (2, other, None, None), (3, t, None, None), (4, t[::-1], None, None)])
    pairs = {(r.a, r.b) for r in edit_embedding.near_pairs(rows).collect()}
    fp = {r.doc_id: r.fingerprint for r in edit_embedding.fingerprint(rows).collect()}
    assert fp[1] != fp[2] and pairs == {tuple(sorted((fp[1], fp[2])))}


def test_recall_at_the_radius(spark):
    rng = np.random.default_rng(15)
    left = rng.integers(0, 2, (300, 256), np.uint8)
    right = left.copy()
    for row in right:
        row[rng.permutation(256)[:40]] ^= 1
    hexes = [[np.packbits(row).tobytes().hex() for row in x] for x in (left, right)]
    want = {tuple(sorted(x)) for x in zip(*hexes, strict=True)}
    table = spark.createDataFrame([(x,) for x in hexes[0] + hexes[1]], "fingerprint string")
    found = {(r.a, r.b) for r in edit_embedding.near_fingerprints(table, 40, edit_embedding.bands_for(40, 16, 0.95), 16).collect()}
    few = {(r.a, r.b) for r in edit_embedding.near_fingerprints(table, 40, 24, 16).collect()}
    print("recall", len(found & want) / 300, len(few & want) / 300)
    assert found <= want and len(found) >= 0.92 * 300 and len(few & want) < 0.9 * 300


# Language model.


def test_scores(spark, corpus, corpus_dir):
    got = {r.doc_id: r for r in queries.op3_hmm(spark, corpus_dir).collect()}
    want, total = brute.unigram([(i, t) for i, t, _, _ in corpus])
    for i, (n, known, base) in want.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in got.values())


def test_forward_and_expected_counts_equal_enumeration():
    rng = np.random.default_rng(2)
    m = hmm.Hmm.of_counts(rng.random(2), rng.random((2, 2)), rng.random((3, 2)))
    seqs = [np.array([0, 2, 1, 1], np.uint16), np.array([2], np.uint16), np.array([1, 0], np.uint16)]
    total, start, move, emit = [], np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for s in seqs:
        ways = {}
        for code in range(2 ** len(s)):
            z = [code >> i & 1 for i in range(len(s))]
            p = m.start[z[0]] * m.emit[s[0], z[0]]
            for a, b, x in zip(z, z[1:], s[1:], strict=False):
                p *= m.move[a, b] * m.emit[x, b]
            ways[tuple(z)] = p
        all_ = sum(ways.values())
        total.append(np.log(all_))
        for z, p in ways.items():
            start[z[0]] += p / all_
            for a, b in zip(z, z[1:], strict=False):
                move[a, b] += p / all_
            for x, k in zip(s, z, strict=True):
                emit[x, k] += p / all_
    assert np.allclose(m.forward(seqs), total)
    for got, want in zip(m.expect(seqs), (start, move, emit), strict=True):
        assert np.allclose(got, want)


def test_score_edges(spark, make, none):
    true = F.lit(True)
    assert hmm.score(none, true).count() == 0
    untrained = hmm.score(make([(1, "a b", None, None)]), F.lit(False)).first()
    assert (untrained.n_tokens, untrained.n_known, untrained.train_tokens, untrained.base_score) == (3, 0, 0, 0.0)
    rows = hmm.score(make([(1, None, None, None), (1, None, None, None), (None, "A a", None, None)]).withColumn("uid", F.lit(1)), true).collect()
    assert len(rows) == 3 and sorted(r.n_tokens for r in rows) == [1, 1, 3] and len({r.score for r in rows}) == 2


# Pieces.


def all_ways(pieces, word):
    edges, out = pieces.edges(word), []

    def go(i, score, ids):
        if i == len(word):
            out.append((score, ids))
        else:
            for j, s, d in edges[i]:
                go(j, score + s, ids + d)

    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


def test_n_best_equals_enumeration():
    pieces = piece_lattice.load(piece_lattice.default_model())
    for word in (" hello", " théâtre", "aaaaaaa", " 中x", "\n.\n", "   of"):
        ways = all_ways(pieces, word)
        assert [s for s, _ in pieces.ranked(word, 6)] == pytest.approx([s for s, _ in ways[:6]])
        score, loss, ids = pieces.best(word)
        assert score == pytest.approx(ways[0][0]) and tuple(ids) in {w for s, w in ways if s == pytest.approx(score)}
        assert len(ways) == 1 or loss == pytest.approx(ways[0][0] - ways[1][0])
    for text in ("the cat sat", "a bc  d", "ab, ab", "x\n y", "   z"):
        ways = all_ways(pieces, " " + text)  # of the whole text, uncut
        ids, found = pieces.n_best(text, 8)
        assert [s for s, _ in found] == pytest.approx([s for s, _ in ways[:8]])
        by_ids = {w: s for s, w in ways}
        each = [tuple(piece_lattice.changed(ids, c)) for _, c in found]
        assert len(set(each)) == len(each) and [by_ids[x] for x in each] == pytest.approx([s for s, _ in found])


def test_words_side_by_side_equal_one_by_one(corpus):
    pieces = piece_lattice.load(piece_lattice.default_model())
    rng = random.Random(21)
    words = ["".join(rng.choices("abeinrst éü中.,0", k=rng.randint(1, 60))) for _ in range(400)] + [" ", "a", "\n", "x" * 47, "x" * 48, "x" * 49, "    the"]
    found = pieces.segment(words)
    for i, w in enumerate(words):
        score, loss, ids = pieces.best(w)
        assert found.score[i] == pytest.approx(score) and found.of(i).tolist() == ids
        assert found.loss[i] == pytest.approx(loss)


def test_scores_are_probabilities_and_pieces_few(corpus):
    import sentencepiece

    pieces = piece_lattice.load(piece_lattice.default_model())
    assert sum(np.exp(s) for s, _ in pieces.scores.values()) == pytest.approx(1.0)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.default_model())
    prose = "The committee met on Tuesday, and nobody could say which of the three reports was the one that mattered most.  Later they read all of them."
    assert len(pieces.n_best(prose, 1)[0]) <= 1.05 * len(library.encode(prose))
    assert [pieces.raw[i] for i in pieces.n_best("hello  world", 1)[0]][-2:] == [b" ", b" world"] or b"  " in [pieces.raw[i] for i in pieces.n_best("hello  world", 1)[0]]


def test_ties_go_to_the_longer_last_piece():
    pieces = piece_lattice.load(piece_lattice.default_model())
    two = [i for i in pieces.best("aaa")[2]]
    ways = [w for s, w in all_ways(pieces, "aaa") if s == pytest.approx(pieces.best("aaa")[0])]
    assert len(pieces.raw[two[-1]]) == max(len(pieces.raw[w[-1]]) for w in ways)


def test_round_trip(spark, corpus, corpus_dir):
    rows = queries.op4_piece_lattice(spark, corpus_dir).collect()
    assert len(rows) == len(corpus) and all(r.round_trip and all(r.round_trips) and len(r.round_trips) == len(r.scores) for r in rows)
    assert max(len(r.scores) for r in rows) == 4 and all(list(r.scores) == sorted(r.scores, reverse=True) for r in rows)
    pieces = piece_lattice.load(piece_lattice.default_model())
    for s in ("a  b\n▁x  ", " lead", "  ", "▁", "\x00 \U0001f600"):
        ids, ways = pieces.n_best(s, 3)
        each = [piece_lattice.changed(ids, c) for _, c in ways]
        assert all(pieces.decode(x) == s for x in each) and len({tuple(x) for x in each}) == len(each)


def test_a_wrong_segmentation_is_told(spark, make):
    made = piece_lattice.encode(make([(1, "some words here", None, None)]), n=3).withColumn("text", F.lit("some words there"))
    assert piece_lattice.round_trips(made).first().round_trips == [False] * 3


def test_decoding_takes_any_ids(spark):
    pieces = piece_lattice.load(piece_lattice.default_model())
    word = pieces.n_best("word", 1)[0]
    rows = [([pieces.bytes[0xC3]],), ([1, *word, 2],), ([-5, *word, 10**6, None],), ([],), (None,), ([i for i in word if not pieces.raw[i].startswith(b" ")] or word,), ([pieces.bytes[0xC3], pieces.bytes[0xA9]],)]
    out = [r.decoded for r in piece_lattice.decode(spark.createDataFrame(rows, "ids array<int>").coalesce(1)).collect()]
    assert out[:5] == ["\ufffd", "word", "word", "", None] and out[6] == "é"


def test_piece_edges(spark, make, none):
    assert piece_lattice.encode(none).count() == 0 and piece_lattice.round_trips(piece_lattice.encode(none)).count() == 0
    out = piece_lattice.decode(piece_lattice.encode(make([(1, None, None, None), (1, "", None, None), (None, "x" * 5000, None, None)]).withColumn("IDS", F.lit(1)), n=2)).collect()
    assert [len(r.ids) for r in out[:2]] == [0, 0] and out[2].decoded == "x" * 5000 and len(out[2].changes) == 1
    assert [list(r.scores) for r in out[:2]] == [[0.0]] * 2


# Near duplicates.


def test_simhash_components(spark, corpus, corpus_dir):
    prints = {i: brute.simhash(t) for i, t, _, _ in corpus}
    want = brute.components(prints, 2)
    got = by_id(queries.op5_simhash(spark, corpus_dir), "fingerprint", "component_id")
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert got[90][0] == got[91][0] == "0" * 16 and got[91][1] == 90


def test_bk_forest_equals_all_pairs():
    rng = np.random.default_rng(4)
    for bits, radius in ((64, 2), (64, 9), (256, 40)):
        base = rng.integers(0, 1 << 63, (30, bits // 64), np.uint64)
        lanes = np.concatenate([base, base[:20] ^ np.uint64(1), base[:10] ^ np.uint64(0b1110)])
        shard = np.sort(rng.integers(0, 4, len(lanes)))
        forest = simhash.BkForest(lanes, shard)
        a, b = forest.search(np.arange(len(lanes)), radius)
        near = {(i, j) for i in range(len(lanes)) for j in range(len(lanes)) if i != j and shard[i] == shard[j] and int(np.bitwise_count(lanes[i] ^ lanes[j]).sum()) <= radius}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == near
        label = forest.components(radius)
        assert all(label[i] == label[j] for i, j in near)


def test_shards_after_a_large_one_are_searched():
    rng = np.random.default_rng(9)
    flips = [0, *[1 << i for i in range(64)], *[1 << i | 1 << j for i in range(64) for j in range(i)]][:600]
    large = np.uint64(rng.integers(0, 1 << 63)) ^ np.array(flips, np.uint64)
    base = rng.integers(0, 1 << 63, (3, 200), np.uint64)
    small = np.concatenate([base, base ^ np.uint64(1)], 1)
    lanes, shard = np.concatenate([large, small.ravel()])[:, None], np.repeat(np.arange(4), [600, 400, 400, 400])
    label = simhash.BkForest(lanes, shard).components(2)
    near = (np.bitwise_count(lanes ^ lanes.T) <= 2) & (shard[:, None] == shard)
    assert (label[:600] == 0).all() and len(np.unique(label)) == 1 + 600
    a, b = np.nonzero(near)
    assert (label[a] == label[b]).all()


def test_block_keys_miss_nothing():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, (50, 1), np.uint64)
    for i in range(64):
        y = x ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64((i * 7 + 1) % 64))
        assert (simhash.Blocks(2).keys(x) == simhash.Blocks(2).keys(y)).any(1).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_copies_go(spark, make, none, corpus):
    rng = random.Random(8)
    base = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(150)) for _ in range(40)]
    rows = [(i, t, "aa", "s") for i, t in enumerate(base)]
    near = []
    for i, t in enumerate(base[:20]):
        w = t.split()
        for k in rng.sample(range(150), 2):
            w[k] = "other"
        near.append((100 + i, " ".join(w), "aa", "s"))
    kept = {r.doc_id for r in simhash.drop_near_copies(make(rows + near + rows[:5] + [(None, base[0], "aa", "s")])).collect()}
    assert kept >= set(range(40)) | {None} and len(kept & set(range(100, 120))) <= 1
    again = simhash.drop_near_copies(make(rows + rows[:5])).collect()
    assert len(again) == 40
    assert simhash.drop_near_copies(none).count() == 0 and simhash.near_duplicates(none).count() == 0
    several = [(1, base[0], None, "s"), (1, base[1], None, "s"), (2, base[2], None, "s"), (1, base[1], None, "s"), (3, base[1], None, "s"), (3, base[3], None, "s")]
    left = sorted((r.doc_id, r.text) for r in simhash.drop_near_copies(make(several)).collect())
    assert left == sorted([(1, base[0]), (1, base[1]), (2, base[2]), (3, base[3])])
    clash = simhash.drop_near_copies(make(rows[:2]).withColumn("lanes", F.lit("x")).withColumn("count", F.lit(1)))
    assert clash.count() == 2 and clash.columns[-2:] == ["lanes", "count"]


def jaccard_components(texts, shingle=5, similarity=0.8):
    sets = {i: set(simhash.shingle_hashes(t, shingle).tolist()) for i, t in texts.items()}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
    return label


def test_only_similar_texts_go(spark, make):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    line = " ".join(word() for _ in range(16))
    shared = [" ".join([line, *(w for _ in range(20) for w in (line,)), *(word() for _ in range(104))]) for _ in range(6)]
    texts = dict(enumerate(shared))
    for n, changed in ((200, 4), (200, 5), (200, 6), (200, 7), (200, 9), (60, 1), (60, 2), (28, 1), (12, 1), (9, 1), (8, 1)):
        for _ in range(12):
            w = [word() for _ in range(n)]
            first = len(texts)
            texts[first] = " ".join(w)
            for _ in range(2):
                other = list(w)
                for k in rng.sample(range(0, n, 1 + n // 20), changed) if n >= 60 else [rng.choice((0, n - 1))]:
                    other[k] = word()
                texts[len(texts)] = " ".join(other)
    want = jaccard_components(texts)
    kept = {r.doc_id for r in simhash.drop_near_copies(make([(i, t, "aa", "s") for i, t in texts.items()])).collect()}
    clean, copies = {i for i in want if want[i] == i}, {i for i in want if want[i] != i}
    assert clean <= kept and set(range(6)) <= clean and len(copies) > 60
    assert len(copies & kept) <= 0.03 * len(copies)
    short = {i for i in copies if len(texts[i].split()) <= 28}
    assert short and not short & kept


def test_parts_of_a_broken_candidate_are_told_apart(spark, make, monkeypatch):
    rng = random.Random(13)
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    rows = []
    for i in range(24):
        w = list(base)
        for k in range(5, 5 * (2 * i + 1), 10):
            w[k] = f"new{k}"
        rows.append((i, " ".join(w), "aa", "s"))
    rng.shuffle(rows)
    want = jaccard_components({i: t for i, t, _, _ in rows})
    assert set(want.values()) == {0}
    monkeypatch.setattr(simhash, "PAIRS", 64)
    assert [r.doc_id for r in simhash.drop_near_copies(make(rows)).collect()] == [0]


def test_set_components_equal_all_pairs():
    rng = np.random.default_rng(14)
    sets = [np.unique(rng.integers(0, 9, rng.integers(3, 9)).astype(np.uint64)) for _ in range(60)]
    label = simhash.set_components(sets, 0.8)
    near = np.array([[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for b in sets] for a in sets])
    while (near != (near @ near)).any():
        near = near @ near
    assert label.tolist() == near.argmax(1).tolist()


# Substrings.


def test_fm_index_equals_counting():
    rng = np.random.default_rng(6)
    tokens = np.concatenate([rng.integers(1, 5, 400), [0], rng.integers(1, 5, 100), [0]])
    index = FmIndex(tokens, 6)
    starts = np.array([s for s in range(len(tokens) - 6) if (tokens[s : s + 6] > 0).all()])
    low, high = index.intervals(starts, 6)
    for s, a, b in zip(starts, low, high, strict=True):
        want = {i for i in starts if (tokens[i : i + 6] == tokens[s : s + 6]).all()}
        assert set(index.suffixes[a:b].tolist()) == want


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(16)
    for depth, kinds in ((5, 3), (3, 2), (13, 2)):
        texts = [rng.integers(1, kinds + 1, rng.integers(1, 30)) for _ in range(25)]
        owner = rng.integers(0, 6, 25)
        tokens = np.concatenate([np.append(t, 0) for t in texts])
        end = np.cumsum([len(t) + 1 for t in texts]) - 1
        begin = end - [len(t) for t in texts]
        got = FmIndex(tokens, depth).matching_statistics(np.repeat(owner, end - begin + 1), begin, end, owner)
        for k, t in enumerate(texts):
            known = {tuple(u[i : i + n]) for j, u in enumerate(texts) if owner[j] < owner[k] for n in range(1, depth + 1) for i in range(len(u) - n + 1)}
            want = [max((n for n in range(1, min(depth, len(t) - i) + 1) if tuple(t[i : i + n]) in known), default=0) for i in range(len(t))]
            assert got[begin[k] : end[k]].tolist() == want


@pytest.mark.parametrize("frequent,stretch", [(5000, 64), (1, 64), (5000, 3)])
def test_repeats(spark, corpus, corpus_dir, frequent, stretch, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(substring_dedup, "STRETCH", stretch)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 200)
    want = brute.substring_dedup([(i, t) for i, t, _, _ in corpus])
    got = by_id(queries.op9_substring_dedup(spark, corpus_dir), "n_words", "n_removed", "kept_sha256")
    assert got == {i: (n, k, hashlib.sha256(s.encode()).hexdigest()) for i, (n, k, s) in want.items()}
    assert sum(k for _, k, _ in want.values()) > 500


def test_phrases_repeated_within_a_text(spark, make):
    rng = random.Random(22)
    phrase = [f"p{i}" for i in range(3)] * 300
    docs = [(5, " ".join(phrase)), (7, " ".join(["x", *phrase[:200], "y", *phrase[1:150]])), (9, " ".join(rng.choices(["a", "b"], k=400))), (11, " ".join(rng.choices(["a", "b"], k=400))), (3, "z " * 100), (4, "z " * 12), (6, "z " * 13)]
    got = by_id(substring_dedup.deduplicate(make([(i, t, None, None) for i, t in docs])), "n_words", "n_removed", "kept")
    assert got == brute.substring_dedup(docs)


def test_no_table_is_left(spark, make, tmp_path):
    from hydroseries.llm import common

    names = lambda: {t.name for t in spark.catalog.listTables()}
    before = names()
    with common.intermediates(spark):
        path = common.new_table(spark, "probe")
        kept = substring_dedup.remove_repeats(make([(1, "a " * 20, None, None), (2, "a " * 20, None, None)])).collect()
        spark.range(3).write.parquet(path)
        assert len(os.listdir(path.removeprefix("file://"))) > 0
    assert len(kept) == 1 and names() == before and not os.path.exists(path.removeprefix("file://"))


def test_repeat_edges(spark, make, none):
    assert substring_dedup.deduplicate(none).count() == 0
    t = " ".join(f"w{i}" for i in range(20))
    rows = make([(1, t, None, None), (1, t, None, None), (None, t, None, None), (None, t + "  x", None, None), (2, "a " * 40, None, None)]).withColumn("body", F.lit("kept")).withColumn("uid", F.lit(0))
    got = sorted((r.doc_id is None, r.n_words, r.n_removed) for r in substring_dedup.deduplicate(rows).collect())
    assert got == [(False, 20, 0), (False, 20, 0), (False, 40, 0), (True, 20, 20), (True, 21, 20)]
    kept = substring_dedup.remove_repeats(rows)
    assert kept.columns == rows.columns and sorted(r.text for r in kept.collect()) == sorted([t, t, "x", "a " * 40]) and {r.body for r in kept.collect()} == {"kept"}
