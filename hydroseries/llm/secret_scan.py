"""Secret scans: patterns, and long strings that look random, found with a controlled share of false ones.

1. Base spans are those of three patterns: an assignment to a telling name, an access key, a long run of hex digits.
2. Candidates are runs of at least LENGTHS[0] characters that encodings are made of. Each one's encoding is inferred: the smallest
   alphabet that holds it. A battery asks whether its symbols could be drawn evenly from that alphabet: a chi-squared test of their
   counts, a runs test about the alphabet's middle and a test of serial correlation; Fisher's rule joins the three to one number u, which
   is even on 0..1 for random strings and near 0 for others.
3. What ordinary text makes of the battery depends on length and encoding, so it is measured: the characters of every document outside candidates
   that the alphabet has, in the alphabet's case where it has one case only, are cut into decoys of each length class, all of them from end to end. The share of decoys with as high a u is a candidate's p-value, and in each encoding and length class the step-up rule of
   false-discovery control keeps candidates as long as at most `rate` of the kept are expected to be false. Short strings, of which much
   ordinary text looks random, pass only where the evidence is there.

Texts are read once; what a document gives is a row of spans and candidates in the shared folder, and a batch's first row holds the counts of its decoys. Candidates and decoys are
counted in cells of (encoding, length class, u in BINS steps): a fixed number, whatever the input.

Positions are code points, ends exclusive. Defined cases: a null or empty text has no spans; a string of characters from no single
alphabet is no candidate; padding (=) belongs to a candidate's span but not to its symbols; a candidate that overlaps a base span is
tested and counted, but gives no span of its own; repeated rows are scanned alike, and each counts; an empty table gives no rows;
columns that are kept keep their names, whatever they are, except those of the result.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_pandas, write_shared

_DIGITS, _LOWER, _UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings and their alphabets, small ones first.
ENCODINGS = {
    "digits": _DIGITS,
    "lower_hex": _DIGITS + _LOWER[:6],
    "upper_hex": _DIGITS + _UPPER[:6],
    "base32": _UPPER + b"234567",
    "lower_base36": _DIGITS + _LOWER,
    "upper_base36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + b"+/",
    "base64url": _UPPER + _LOWER + _DIGITS + b"-_",
}
#: Shortest length of each length class; decoys have just that length.
LENGTHS = (16, 20, 24, 32, 40, 48, 64, 96, 128)
BINS = 1000
#: Characters of text whose decoys are counted at once, and symbols of decoys.
CHARACTERS, SYMBOLS = 1 << 18, 1 << 17
#: Symbols whose counts are told once for all lengths that it divides.
BLOCK = 8
#: Kinds of spans: patterns first, then strings found by their randomness.
KINDS = ("assign", "access", "hex", *ENCODINGS)
#: Each pattern, which group must be how long at least; matches that are shorter are dropped after matching.
PATTERNS = (
    (re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 12),
    (re.compile(rb"AKIA[A-Z0-9]+"), 0, 18),
    (re.compile(rb"[0-9a-f]{16,}"), 0, 16),  # runs are maximal, so shorter ones need not be matched
)
#: One of these is in each match of the first pattern, in some case.
_TELLING = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_CANDIDATE = re.compile(rb"([A-Za-z0-9+/_-]{%d,})={0,2}" % LENGTHS[0])
#: Characters of a run are ones, others zeros; and the shortest run.
_HEX, _TOKEN = (bytes(int(b in alphabet) for b in range(256)) for alphabet in (ENCODINGS["lower_hex"], ENCODINGS["base64"] + b"-_"))
_RUN = b"\1" * LENGTHS[0]
_SYMBOL = np.array([[alphabet.find(bytes([b])) for b in range(256)] for alphabet in ENCODINGS.values()], np.int64)
_OTHERS = [bytes(b for b in range(256) if b not in alphabet) for alphabet in ENCODINGS.values()]
_SIZES = np.array([len(a) for a in ENCODINGS.values()])
#: The case of encodings that have one.
_CASE = {"lower_hex": "l", "lower_base36": "l", "upper_hex": "u", "base32": "u", "upper_base36": "u"}
#: Encodings whose decoys are those of another one in the other case.
_ALIKE = {"upper_hex": "lower_hex", "upper_base36": "lower_base36"}
#: Encodings whose symbols of many texts are another one's, plus a number: those of texts without the characters that it adds to the other alphabet, or, where a number is added, of letters only.
_ALONG = {list(ENCODINGS).index(name): (list(ENCODINGS).index(lead), added) for name, lead, added in (("base64", "base62", 0), ("base64url", "base62", 0), ("lower_base36", "base32", 10))}
_LEAST = 1e-300
_erfc = np.frompyfunc(math.erfc, 1, 1)


def battery(symbols: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The p-values of uniformity, runs and serial correlation, and u, of strings of symbols 0..size-1, laid end to end; each has two symbols or more."""
    if not len(lengths):
        return (np.zeros(0),) * 4
    n = lengths.astype(float)
    start = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    # A string's counts of each symbol, squared and summed.
    cell, count = np.unique(owner * size + symbols, return_counts=True)
    square = np.bincount(cell // size, weights=count.astype(float) ** 2, minlength=len(lengths))
    freedom = (size - 1) * n / (n - 1)  # has the exact mean and variance of the statistic under evenness
    spread = 2 / (9 * freedom)
    uniform = _normal((np.cbrt((size / n * square - n) / (size - 1)) - (1 - spread)) / np.sqrt(spread))

    within = owner[1:] == owner[:-1]
    high = 2 * symbols >= size
    changes = np.bincount(owner[1:], weights=within & (high[1:] != high[:-1]), minlength=len(lengths))
    above = np.add.reduceat(high.astype(float), start)
    expected = 1 + 2 * above * (n - above) / n
    variance = (expected - 1) * (expected - 2) / (n - 1)
    one_sided = (above == 0) | (above == n)
    runs = np.where(one_sided, np.exp2(1 - np.minimum(n, 900)), _normal((changes + 1 - expected) / np.sqrt(np.where(variance > 0, variance, 1))))

    off = symbols - (np.add.reduceat(symbols.astype(float), start) / n)[owner]
    power = np.add.reduceat(off * off, start)
    product = np.bincount(owner[1:], weights=np.where(within, off[1:] * off[:-1], 0), minlength=len(lengths))
    serial = np.where(power > 0, _normal((product / np.where(power > 0, power, 1) + 1 / n) * np.sqrt(n)), _LEAST)

    uniform, runs, serial = (np.maximum(p, _LEAST) for p in (uniform, runs, serial))
    f = -(np.log(uniform) + np.log(runs) + np.log(serial))
    return uniform, runs, serial, np.exp(-f) * (1 + f + f * f / 2)


def _normal(z: np.ndarray) -> np.ndarray:
    """The two-sided p-value of standard normal numbers."""
    return _erfc(np.abs(z) / math.sqrt(2)).astype(float)


def encoding_of(token: bytes) -> int:
    """The number of the smallest alphabet that holds the token, -1 if none does."""
    return next((k for k, alphabet in enumerate(ENCODINGS.values()) if not token.translate(None, alphabet)), -1)


def _cells(encoding: int | np.ndarray, lengths: np.ndarray, u: np.ndarray) -> np.ndarray:
    stratum = encoding * len(LENGTHS) + np.searchsorted(LENGTHS, lengths, side="right") - 1
    return stratum * BINS + np.minimum((u * BINS).astype(np.int64), BINS - 1)


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each pattern's matches, in order. What each match must hold is sought first, as most texts lack it."""
    low = data.lower()
    there = any(name in low for name in _TELLING), b"AKIA" in data, _RUN in data.translate(_HEX)
    return sorted((m.start(), kind, m.end()) for kind, (pattern, group, least) in enumerate(PATTERNS) if there[kind] for m in pattern.finditer(data) if m.end(group) - m.start(group) >= least)


@functools.cache
def _evidence(size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minus the logarithms of the battery's p-values of strings of n symbols: by the sum of squared counts, by symbols above the middle and changes, and by points of the serial correlation's z."""
    minus_log = lambda p: -np.log(np.maximum(p, _LEAST))
    spread = 2 / (9 * (size - 1) * n / (n - 1))
    uniform = _normal((np.cbrt((size / n * np.arange(n * n + 1) - n) / (size - 1)) - (1 - spread)) / math.sqrt(spread))
    above, changes = np.arange(n + 1)[:, None], np.arange(n)
    expected = 1 + 2 * above * (n - above) / n
    variance = (expected - 1) * (expected - 2) / (n - 1)
    runs = _normal((changes + 1 - expected) / np.sqrt(np.where(variance > 0, variance, 1)))
    runs[[0, n]] = 2.0 ** (1 - n)
    z = np.linspace(0, 2 * math.sqrt(n), 8193)
    return minus_log(uniform), minus_log(runs), z, minus_log(_normal(z))


def _blocks(x: np.ndarray, offset: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, the number of its first whole block of BLOCK symbols, and the counts of each symbol in each block of all pieces."""
    each = lengths // BLOCK
    first = np.cumsum(each) - each
    start = np.repeat(offset, each) + (np.arange(each.sum()) - np.repeat(first, each)) * BLOCK
    counts, window = np.empty((len(start), size), np.uint8), np.lib.stride_tricks.sliding_window_view(x, BLOCK)
    for a in range(0, len(start), SYMBOLS // BLOCK):
        some = window[start[a : a + SYMBOLS // BLOCK]]
        some += size * np.arange(len(some))[:, None]
        counts[a : a + len(some)] = np.bincount(some.ravel(), minlength=len(some) * size).reshape(len(some), size)
    return first, counts


def _squares(blocks: np.ndarray, first: np.ndarray, n: int, counts: np.ndarray | None = None) -> np.ndarray:
    """The sums of squared counts of n blocks from each first one on; a count is at most LENGTHS[-1], so the sums fit in 16 bits. Their counts are put into counts."""
    out = np.empty(len(first), np.int64)
    rows = max(1, SYMBOLS // blocks.shape[1])
    for a in range(0, len(first), rows):
        at = first[a : a + rows]
        count = blocks[at]
        for k in range(1, n):
            count += blocks[at + k]
        if counts is not None:
            counts[a : a + rows] = count
        count = count.astype(np.uint16)
        out[a : a + rows] = np.einsum("ij,ij->i", count, count)
    return out


def _even_interp(x: np.ndarray, z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """np.interp for points z in even steps from 0."""
    place = np.minimum(x * ((len(z) - 1) / z[-1]), len(z) - 1)
    low = np.minimum(place.astype(np.int64), len(z) - 2)
    return y[low] + (y[low + 1] - y[low]) * (place - low)


def _sums(a: np.ndarray, kind: type) -> np.ndarray:
    """The sums of the first 0, 1, 2... numbers."""
    out = np.zeros(len(a) + 1, kind)
    np.cumsum(a, dtype=kind, out=out[1:])
    return out


def _count_decoys(e: int, pieces: list[bytes], counts: np.ndarray, alike: tuple[tuple[int, int], ...] = ()) -> None:
    """Adds the cells of the decoys of pieces, of LENGTHS[0] symbols or more each, to counts: for each length, each piece from end to end, the last one up to its end.

    alike: other encodings in which the symbols of all these pieces are those of e plus a number, and that number; their cells are added too. Counts of equal symbols and the
    serial correlation are the same for them, so they are told once.
    """
    if not pieces:
        return
    size, lengths = int(_SIZES[e]), np.fromiter(map(len, pieces), np.int64, len(pieces))
    offset = np.cumsum(lengths) - lengths
    x = _SYMBOL[e].astype(np.int32)[np.frombuffer(b"".join(pieces), np.uint8)]
    kind = np.int32 if len(x) < 1 << 19 else np.int64  # sums of squares of symbols below 64 fit
    total, squares, products = _sums(x, kind), _sums(x * x, kind), _sums(x[1:] * x[:-1], kind)
    judged = {}  # by alphabet size and added number: symbols above the middle, changes, and the encodings
    for other, added in ((e, 0), *alike):
        key = int(_SIZES[other]), added
        if key not in judged:
            high = 2 * (x + added) >= key[0]
            judged[key] = _sums(high, kind), _sums(high[1:] != high[:-1], kind), []
        judged[key][2].append(other)
    tables = {BLOCK: _blocks(x, offset, lengths, size)}  # by length: each piece's first stretch of that length, and the symbols' counts in each
    for n in LENGTHS:
        if not (lengths >= n).any():
            break
        each = lengths // n
        first = np.cumsum(each) - each
        own = np.repeat(np.arange(len(each)), each)
        step = np.arange(len(own)) - first[own]
        last = np.flatnonzero((lengths > n) & (lengths % n > 0))
        start = np.concatenate((offset[own] + step * n, (offset + lengths - n)[last]))
        square, done = np.empty(len(start), np.int64), 0
        part = max((m for m in tables if n % m == 0), default=0)
        if part:  # counts of whole stretches are added up from shorter ones
            done, count = len(own), None
            if any(m > n and m % n == 0 for m in LENGTHS):
                count = np.empty((len(own), size), np.uint8)
                tables[n] = first, count
            square[:done] = _squares(tables[part][1], tables[part][0][own] + step * (n // part), n // part, count)
        window = np.lib.stride_tricks.sliding_window_view(x, n)
        for a in range(done, len(start), SYMBOLS // n):
            some = window[start[a : a + SYMBOLS // n]]
            some += size * np.arange(len(some))[:, None]
            count = np.bincount(some.ravel(), minlength=len(some) * size).reshape(len(some), size)
            square[a : a + SYMBOLS // n] = np.einsum("ij,ij->i", count, count)
        end = start + n
        # n ** 2 times the sums about the mean: whole numbers, the same whatever is added to the symbols.
        one, two, next_ = ((s[b] - s[a]).astype(float) for s, a, b in ((total, start, end), (squares, start, end), (products, start, end - 1)))
        power = n * two - one * one
        product = n * (n * next_ + one * (x[start] + x[end - 1]) + two) - (n + 2) * one * one  # with the power, for the statistic's 1 / n
        even = power > 0  # not all symbols are the same
        z, serial = _evidence(size, n)[2:]
        serial = np.where(even, _even_interp(np.abs(product) / np.where(even, power * math.sqrt(n), 1), z, serial), -math.log(_LEAST))
        for (among, _), (above, changes, encodings) in judged.items():
            uniform, runs, *_ = _evidence(among, n)
            f = uniform[square] + runs.ravel()[(above[end] - above[start]) * n + (changes[end - 1] - changes[start])] + serial
            cells = np.bincount(np.minimum((np.exp(-f) * (1 + f + f * f / 2) * BINS).astype(np.int64), BINS - 1), minlength=BINS)
            for other in encodings:
                low = (other * len(LENGTHS) + LENGTHS.index(n)) * BINS
                counts[low : low + BINS] += cells


class Texts:
    """Base spans, candidates and decoys of some texts. Texts are held as one byte a code point; what is no ASCII is in no pattern and no alphabet."""

    def __init__(self, texts: list[str | None]):
        self.base, self.candidates = [], []  # of each text: (start, kind, end), (start, end, encoding)
        tokens, self.ordinary = [], []
        for text in texts:
            data = (text or "").encode("ascii", "replace")
            self.base.append(base_spans(data))
            found, rest, at = [], [], 0
            for m in _CANDIDATE.finditer(data) if _RUN in data.translate(_TOKEN) else ():
                encoding = encoding_of(m.group(1))
                if encoding >= 0:
                    found.append((m.start(), m.end(), encoding))
                    tokens.append(m.group(1))
                rest.append(data[at : m.start()])
                at = m.end()
            self.candidates.append(found)
            self.ordinary.append(b" ".join([*rest, data[at:]]) if rest else data)
        self._judge(tokens)

    def _judge(self, tokens: list[bytes]) -> None:
        encoding = np.array([e for found in self.candidates for _, _, e in found], np.int64)
        self.tests, self.cell = np.zeros((len(tokens), 3)), np.zeros(len(tokens), np.int64)
        for e in np.unique(encoding):
            at = np.flatnonzero(encoding == e)
            lengths = np.array([len(tokens[i]) for i in at])
            *tests, u = battery(_SYMBOL[e][np.frombuffer(b"".join(tokens[i] for i in at), np.uint8)], lengths, _SIZES[e])
            self.tests[at], self.cell[at] = np.stack(tests, 1), _cells(e, lengths, u)

    def decoys(self) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the decoys of all texts, and how many there are of each."""
        counts = np.zeros(len(ENCODINGS) * len(LENGTHS) * BINS, np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum([len(x) for x in self.ordinary]) // CHARACTERS)) + 1 if self.ordinary else []
        for a, b in zip([0, *cut], [*cut, len(self.ordinary)], strict=True):
            cases = {"": self.ordinary[a:b], "l": [x.lower() for x in self.ordinary[a:b]], "u": [x.upper() for x in self.ordinary[a:b]]}
            kept = {e: [x.translate(None, _OTHERS[e]) for x in cases[_CASE.get(name, "")]] for e, name in enumerate(ENCODINGS) if name not in _ALIKE}
            pieces = defaultdict(list)  # by encoding and those that go along
            for k in range(b - a):
                along = defaultdict(tuple)
                for e, (lead, added) in _ALONG.items():
                    x = kept[e][k]
                    if len(x) == len(kept[lead][k]) and (not added or x.isalpha()):
                        along[lead] += ((e, added),)
                    else:
                        pieces[e, ()].append(x)
                for e in kept.keys() - _ALONG.keys():
                    pieces[e, along[e]].append(kept[e][k])
            for (e, alike), some in pieces.items():
                _count_decoys(e, [x for x in some if len(x) >= LENGTHS[0]], counts, alike)
        each = counts.reshape(len(ENCODINGS), -1)
        for name, as_ in _ALIKE.items():
            each[list(ENCODINGS).index(name)] = each[list(ENCODINGS).index(as_)]
        cells = np.flatnonzero(counts)
        return cells, counts[cells]

    def outside(self, k: int) -> list[bool]:
        """Of each candidate of text k: does it overlap no base span?"""
        begins = np.array([s for s, _, _ in self.base[k]], np.int64)
        reach = np.maximum.accumulate(np.array([e for _, _, e in self.base[k]], np.int64)) if len(begins) else begins
        out = []
        for start, end, _ in self.candidates[k]:
            before = np.searchsorted(begins, end)  # base spans that start before its end
            out.append(not before or int(reach[before - 1]) <= start)
        return out


_SPAN = "struct<start: long, kind: int, end: long>"
_FOUND = "struct<start: long, end: long, encoding: int, cell: int, apart: boolean, p_uniform: double, p_runs: double, p_serial: double>"


def examine(docs: DataFrame) -> DataFrame:
    """base (spans) and found (candidates) of each row's text, decoys (cells and how many) of all texts of a batch in its first row, and the other columns."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t = Texts(pdf["text"].tolist())
            row = iter(zip(t.cell.tolist(), t.tests.tolist(), strict=True))
            base = [[{"start": s, "kind": kind, "end": e} for s, kind, e in spans] for spans in t.base]
            found = []
            for k, spans in enumerate(t.candidates):
                each = []
                for (start, end, encoding), apart in zip(spans, t.outside(k), strict=True):
                    cell, (p, q, r) = next(row)
                    each.append({"start": start, "end": end, "encoding": encoding, "cell": cell, "apart": apart, "p_uniform": p, "p_runs": q, "p_serial": r})
                found.append(each)
            decoys = [[{"cell": c, "n": n} for c, n in zip(*(a.tolist() for a in t.decoys()), strict=True)]] + [[]] * (len(pdf) - 1)
            yield pdf[keep].assign(base=pd.Series(base, index=pdf.index, dtype=object), found=pd.Series(found, index=pdf.index, dtype=object), decoys=pd.Series(decoys[: len(pdf)], index=pdf.index, dtype=object))

    made = T.StructType.fromDDL(f"base array<{_SPAN}>, found array<{_FOUND}>, decoys array<struct<cell: int, n: long>>")
    return map_pandas(docs.select(*keep, "text"), run, T.StructType([docs.schema[c] for c in keep] + made.fields))


def thresholds(examined: DataFrame, rate: float) -> list[int]:
    """For each encoding and length class, the least step of u at which a candidate is called random; BINS where none is.

    decoys: cells, or cells and how many there are of each. Of n candidates, k of them at the step or above, and m decoys, d of them there, n * (d + 1) / (m + 1) / k are expected to be false.
    """
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    decoy = F.explode("decoys").alias("c")
    if isinstance(examined.schema["decoys"].dataType.elementType, T.StructType):
        decoys = examined.select(decoy).select("c.cell", none.alias("n"), F.col("c.n").alias("d"))
    else:
        decoys = examined.select(decoy).select(F.col("c").alias("cell"), none.alias("n"), one.alias("d"))
    found = examined.select(F.explode("found.cell").alias("cell"), one.alias("n"), none.alias("d"))
    counts = found.unionByName(decoys).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    stratum = F.floor(F.col("cell") / BINS)
    whole = Window.partitionBy(stratum)  # at most BINS rows
    above = whole.orderBy(F.desc("cell"))
    expected = F.sum("n").over(whole) * (F.sum("d").over(above) + 1) / (F.sum("d").over(whole) + 1)
    kept = counts.select(stratum.alias("stratum"), "cell", F.sum("n").over(above).alias("k"), expected.alias("false")).where((F.col("k") > 0) & (F.col("false") <= rate * F.col("k")))
    out = [BINS] * (len(ENCODINGS) * len(LENGTHS))
    for row in kept.groupBy("stratum").agg(F.min("cell").alias("cell")).collect():  # one row a stratum
        out[row.stratum] = row.cell % BINS
    return out


def _random(found: Column, least: list[int]) -> Column:
    """Those candidates that are called random."""
    by_stratum = F.array(*map(F.lit, least))
    return F.filter(found, lambda c: F.pmod(c["cell"], F.lit(BINS)) >= F.get(by_stratum, F.floor(c["cell"] / BINS).cast("int")))


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """base and secrets (base spans and those found by randomness) of each row of docs, in order, n_random (strings called random, in base spans too), and the columns of docs but text.

    Both are arrays of (start, kind, end), kind being a place in KINDS.
    """
    examined = write_shared(examine(docs), "examined")
    called = _random(F.col("found"), thresholds(examined, rate))
    added = F.transform(F.filter(called, lambda c: c["apart"]), lambda c: F.struct(c["start"], (c["encoding"] + 3).alias("kind"), c["end"]))
    keep = [c for c in docs.columns if c != "text"]
    return examined.select(*keep, "base", F.array_sort(F.concat("base", added.cast(f"array<{_SPAN}>"))).alias("secrets"), F.size(called).alias("n_random"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """docs, with each secret in text replaced by its kind in brackets. Overlapping secrets become one, under the first one's kind.

    Thresholds are told from one scan, a second one replaces; texts are not shuffled.
    """
    least = np.array(thresholds(write_shared(examine(docs.select("text")), "examined"), rate))

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        t, at, out = Texts(texts.tolist()), 0, []
        random = t.cell % BINS >= least[t.cell // BINS] if len(t.cell) else np.zeros(0, bool)
        for k, text in enumerate(texts):
            found = t.candidates[k]
            called = [(s, e + 3, end) for (s, end, e), r, apart in zip(found, random[at : at + len(found)], t.outside(k), strict=True) if r and apart]
            at += len(found)
            done, new = 0, []
            for start, kind, end in sorted(t.base[k] + called):
                if start >= done:
                    new += [text[done:start], f"[{KINDS[kind]}]"]
                done = max(done, end)
            out.append("".join(new) + text[done:] if new else text)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", replaced("text"))
