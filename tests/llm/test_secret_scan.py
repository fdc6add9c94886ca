"""Secret scans: base spans against plain patterns, the battery against its definitions, planted random strings, edges."""

import hashlib
import math
import random
import re
import statistics
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroseries.llm import queries, secret_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def plain_base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m.group()) >= 16])


def said(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def word(rng):
    return "".join(rng.choices(["th", "er", "on", "an", "in", "re", "ed", "ch", "ei", "ou"], k=rng.randint(1, 5)))


def prose(rng, n=200):
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    """Texts of ordinary words with long words and paths, and for some a random string; {id: (text, random strings)}."""
    rng = random.Random(4)
    alphabets = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/", "0123456789ABCDEF"]
    docs = {}
    for i in range(400):
        words, secrets = prose(rng).split(), []
        words.insert(50, "".join(word(rng) for _ in range(6)))
        words.insert(90, "/".join(word(rng) for _ in range(8)))
        if i % 4 == 0:
            secrets = ["".join(rng.choices(alphabets[i // 4 % 4], k=rng.choice([32, 40, 64])))]
            words.insert(120, secrets[0])
        if i % 5 == 0:
            words.insert(20, f"é{'API_key'}: '{''.join(rng.choices(string.hexdigits, k=rng.randint(8, 30)))}'")
        docs[i] = (" ".join(words), secrets)
    return docs


def test_base_and_planted_strings(spark, planted, tmp_path):
    rows = [(i, t) for i, (t, _) in planted.items()] + [(1000, None), (1001, ""), (1002, "token: secret: abcdefghijklmnop"), (1003, "ToKen=" + "x" * 11 + " PASSWD\"   : 'abcdef0123456789' AKIA" + "A" * 13 + " AKIA" + "B" * 14 + " 中\U0001f600 " + "ab" * 8), (1004, "ſecret=abcdefghijklmnop"), (1005, "abcd " * 300_000 + "deadbeef" * 4)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op12_secret_scan(spark, f"file://{tmp_path}")
    assert df.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(rows)
    missed = wrong = right = 0
    for i, text in rows:
        base, r = plain_base(text), got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        assert r.base_sha256 == hashlib.sha256(said(base).encode()).hexdigest()
        spans = [(int(s), secret_scan.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans) and set(base) <= set(spans)
        added = {text[s:e] for s, k, e in spans if (s, k, e) not in base}
        secrets = {x for x in planted.get(i, ("", []))[1] if not any(s <= text.index(x) < e for s, _, e in base)}
        missed, wrong, right = missed + len(secrets - added), wrong + len(added - secrets), right + len(secrets & added)
    assert right > 60 and missed <= 0.1 * right and wrong <= 0.1 * right


def test_battery_equals_its_definition():
    rng = random.Random(8)
    size = 16
    for _ in range(5):
        strings = [[rng.randrange(size) for _ in range(rng.randint(2, 90))] for _ in range(20)] + [[3] * 20, [0, 15] * 10, list(range(16)), [1, 2]]
        got = secret_scan.battery(np.concatenate(strings), np.array([len(s) for s in strings]), size)
        for k, s in enumerate(strings):
            n = len(s)
            x2 = sum((s.count(c) - n / size) ** 2 / (n / size) for c in range(size))
            free = (size - 1) * n / (n - 1)
            tail = lambda z: max(math.erfc(abs(z) / math.sqrt(2)), 1e-300)
            uniform = tail(((x2 / (size - 1)) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)))
            high = [c >= size / 2 for c in s]
            a, changes = sum(high), sum(x != y for x, y in zip(high, high[1:]))
            m = 1 + 2 * a * (n - a) / n
            v = (m - 1) * (m - 2) / (n - 1)
            runs = 2.0 ** (1 - n) if a in (0, n) else tail((changes + 1 - m) / math.sqrt(v or 1))
            mean = statistics.mean(s)
            power = sum((c - mean) ** 2 for c in s)
            serial = tail((sum((x - mean) * (y - mean) for x, y in zip(s, s[1:])) / power + 1 / n) * math.sqrt(n)) if power else 1e-300
            f = -sum(map(math.log, (uniform, runs, serial)))
            want = (uniform, runs, serial, math.exp(-f) * (1 + f + f * f / 2))
            assert np.allclose([g[k] for g in got], want, rtol=1e-6, atol=1e-12)


def test_random_strings_are_even_and_others_not():
    rng = np.random.default_rng(1)
    for size in (16, 36, 64):
        u = secret_scan.battery(rng.integers(0, size, 40 * 2000), np.full(2000, 40), size)[3]
        assert abs(u.mean() - 0.5) < 0.06 and (u < 0.01).mean() < 0.04
        assert secret_scan.battery(np.arange(64) % size, np.array([64]), size)[3][0] < 0.01
        assert secret_scan.battery(rng.integers(0, size // 3, 40 * 50), np.full(50, 40), size)[3].max() < 0.05


def test_encodings():
    names = list(secret_scan.ENCODINGS)
    for token, name in {"0123": "digits", "0a": "lower_hex", "0A": "upper_hex", "GEZDGNBV": "base32", "z0": "lower_base36", "Z9": "upper_base36", "aZ": "base62", "a+": "base64", "a_Z": "base64url"}.items():
        assert names[secret_scan.encoding_of(token.encode())] == name
    assert secret_scan.encoding_of(b"a+b-") == -1


def test_thresholds_by_hand(spark):
    """One stratum: 10 candidates, 4 of them at step 900 or above, 99 decoys, one of them at 950."""
    b = secret_scan.BINS
    rows = [([{"cell": c} for c in [900, 910, 960, 970, *range(10, 16)]], [0] * 98 + [950]), ([], [b * 3 + 5]), ([{"cell": b * 4 + 1}], [])]
    table = spark.createDataFrame(rows, "found array<struct<cell: int>>, decoys array<int>")
    # At 960: 10 * 1 / 100 / 2; at 900: 10 * 2 / 100 / 4; at 15: 10 * 2 / 100 / 5; at 10: 10 * 2 / 100 / 10
    for rate, want in ((0.009, b), (0.021, 10), (0.019, b), (0.05, 10)):
        got = secret_scan.thresholds(table, rate)
        assert got[0] == want and got[3] == b and got[4] == b
    assert secret_scan.thresholds(table, 1.0)[4] == 1  # one candidate, no decoy: one is expected to be false
    assert secret_scan.thresholds(table.limit(0), 0.5) == [b] * (len(secret_scan.ENCODINGS) * len(secret_scan.LENGTHS))


def test_redaction(spark, planted):
    rows = [(i, t, "x") for i, (t, _) in planted.items()] + [(900, None, "x"), (901, "é token = abcdef0123456789abcdef end", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    out = secret_scan.redact(docs)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns and got[900] is None and got[901] == "é [assign] end"
    hidden = [not any(s in got[i] for s in secrets) for i, (_, secrets) in planted.items() if secrets]
    assert sum(hidden) > 0.85 * len(hidden)
    found = {r.doc_id: r for r in secret_scan.find_secrets(docs.select("doc_id", "text")).collect()}
    assert all((got[i] != t) == bool(found[i].secrets) for i, t, _ in rows if t)


def test_edges(spark, none):
    assert secret_scan.find_secrets(none.select("doc_id", "text")).count() == 0
    rows = spark.createDataFrame([(None, None, "m"), (1, "", "m"), (1, "a" * 5_000_000 + "==", "m"), (1, "deadbeefdeadbeef " * 3000, "m"), (1, "deadbeefdeadbeef " * 3000, "m")], "doc_id long, text string, encoding string")
    out = secret_scan.find_secrets(rows).select("doc_id", "encoding", F.size("base").alias("n"), F.size("secrets").alias("all")).collect()
    # 5,000,000 letters a are hex digits.
    assert sorted((r.doc_id is None, r.n, r.encoding) for r in out) == [(False, 0, "m"), (False, 1, "m"), (False, 3000, "m"), (False, 3000, "m"), (True, 0, "m")]
    assert all(r["all"] == r.n for r in out)


def test_decoys_are_all_of_the_text():
    """Every stretch counts, not one a document: random hex in the middle of a long text gives decoys that look random, as the battery says of each."""
    rng = random.Random(6)
    text = "abc " * 900 + " ".join("".join(rng.choices("0123456789abcdef", k=15)) for _ in range(400)) + " cab" * 900
    cells, counts = secret_scan.Texts([text, None, "zz"]).decoys()
    e = list(secret_scan.ENCODINGS).index("lower_hex")
    kept = "".join(c for c in text if c in "0123456789abcdef")
    want = {}
    for n in secret_scan.LENGTHS:
        for start in range(0, len(kept), n):
            piece = np.array([int(c, 16) for c in kept[min(start, len(kept) - n) :][:n]])
            cell = int(secret_scan._cells(e, np.array([n]), secret_scan.battery(piece, np.array([n]), 16)[3])[0])
            want[cell] = want.get(cell, 0) + 1
    here = {c: k for c, k in zip(cells.tolist(), counts.tolist()) if c // secret_scan.BINS // len(secret_scan.LENGTHS) == e}
    assert sum(here.values()) == sum(want.values()) and sum(abs(here.get(c, 0) - want.get(c, 0)) for c in here.keys() | want) <= 4
    assert sum(k for c, k in here.items() if c % secret_scan.BINS >= 100) > 500


def test_decoys_are_counted_from_blocks():
    """Symbols are counted once in blocks for all lengths that these divide, with the cells that each decoy has on its own."""
    import numpy as np

    from hydroseries.llm import secret_scan

    rng = np.random.default_rng(3)
    name = list(secret_scan.ENCODINGS).index("base64")
    alphabet = np.frombuffer(secret_scan.ENCODINGS["base64"], np.uint8)
    pieces = [bytes(alphabet[np.minimum(rng.integers(0, 64, n), rng.integers(0, 64, n))]) for n in (16, 17, 23, 24, 128, 131, 300, 1000)] + [b"a" * 300]
    x, lengths = secret_scan._SYMBOL[name][np.frombuffer(b"".join(pieces), np.uint8)], np.array([len(p) for p in pieces])
    first, blocks = secret_scan._blocks(x, np.cumsum(lengths) - lengths, lengths, 64)
    for k, piece in enumerate(pieces):
        for n in (1, 2, 3, 16):
            if len(piece) >= 8 * n:
                want = (np.bincount(secret_scan._SYMBOL[name][np.frombuffer(piece[: 8 * n], np.uint8)], minlength=64) ** 2).sum()
                assert secret_scan._squares(blocks, first[k : k + 1], n).tolist() == [want]
    got, want = (np.zeros(len(secret_scan.ENCODINGS) * len(secret_scan.LENGTHS) * secret_scan.BINS, np.int64) for _ in range(2))
    secret_scan._count_decoys(name, pieces, got)
    for n in secret_scan.LENGTHS:
        decoys = [p[min(a, len(p) - n) :][:n] for p in pieces if len(p) >= n for a in range(0, len(p), n)]
        u = secret_scan.battery(secret_scan._SYMBOL[name][np.frombuffer(b"".join(decoys), np.uint8)], np.full(len(decoys), n), 64)[3]
        np.add.at(want, secret_scan._cells(name, np.full(len(decoys), n), u), 1)
    assert got.sum() == want.sum() and np.abs(np.cumsum(got) - np.cumsum(want)).max() <= 1  # a point of the tables may fall in the next cell


def test_encodings_share_what_is_the_same(monkeypatch):
    """Texts of the same symbols in several encodings are counted once for these, with the cells that each encoding has on its own."""
    rng = random.Random(11)
    odd = ["", "-", "_", "+", "/", "3", "9", "-+", "é"]
    texts = ["".join(rng.choices(string.ascii_letters, k=400)) + " " + odd[k % 9].join(prose(rng, 60).title().split()) for k in range(45)] + ["7" * 40, "27" * 30 + " AZ" * 20, None, "x" * 200]
    t = secret_scan.Texts(texts)
    cells, counts = t.decoys()
    names, want = list(secret_scan.ENCODINGS), np.zeros((len(secret_scan.ENCODINGS), len(secret_scan.LENGTHS) * secret_scan.BINS), np.int64)
    for e, name in enumerate(names):
        like = names.index(secret_scan._ALIKE.get(name, name))
        case = {"l": bytes.lower, "u": bytes.upper}.get(secret_scan._CASE.get(names[like]), bytes)
        kept = [case(x).translate(None, secret_scan._OTHERS[like]) for x in t.ordinary]
        own = np.zeros(want.size, np.int64)
        secret_scan._count_decoys(like, [x for x in kept if len(x) >= secret_scan.LENGTHS[0]], own)
        want[e] = own.reshape(want.shape)[like]
    want = want.ravel()
    assert cells.tolist() == np.flatnonzero(want).tolist() and counts.tolist() == want[cells].tolist()

    worked, blocks = [], secret_scan._blocks
    monkeypatch.setattr(secret_scan, "_blocks", lambda x, *rest: worked.append(len(x)) or blocks(x, *rest))
    plain = [prose(rng).title() for _ in range(20)]
    secret_scan.Texts(plain).decoys()
    assert sum(worked) <= 3 * sum(map(len, plain))  # on their own: some five and a half times


def test_base_spans_of_odd_texts():
    rng = random.Random(12)
    parts = ["PassWord", "passwd", "SECRET", "toKen", "API_key", "apikey", "api__key", "pass word", "AKIA", "AKI", "ſecret", "=", ": '", '"', " ", "\n", "é", "a" * 12, "B7" * 9, "0f" * 7, "0f" * 8, "deadbeef", "/+", "x"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 9)))
        assert secret_scan.base_spans(text.encode("ascii", "replace")) == plain_base(text.replace("ſ", "?"))
