"""Language identification of whole texts, with spans for mixed-language texts.

A word is a run of letters and of the marks and joiners that belong to them. Its script, from Unicode ranges, narrows the candidate languages; each candidate's score is the
log-likelihood of the word's character trigrams. Viterbi decoding over the words, with a penalty for each switch of language, labels
spans. The language of a text is the one that most of its letters carry.

The trigram counts are learned from about max_docs labelled documents at most, chosen by a hash of doc_id: a bounded sample, whose whole texts
are read. Every document is labelled over its whole text.

Defined cases: a null text, a text without letters, or a model that saw no labelled document gives `und` with score 0 and no spans;
a word in a script that no training text uses is open to all languages; ties go to the language first by name; repeated rows are
labelled alike; further columns are kept, except those named lang_pred, lang_score and lang_spans, which are replaced.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, hash_sample, map_pandas, release_memory

UNKNOWN = "und"
#: Unicode ranges (first, last) by script.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "ethiopic": ((0x1200, 0x139F),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
}
#: Cells of the trigram table, whatever the number of languages: 64 MB at most.
CELLS = 1 << 24
BUCKETS = 1 << 16
#: Code points that are worked on at once.
BLOCK = 1 << 18
BLOCKED = -40.0


@functools.lru_cache(1)
def _unicode() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, may it stand in a word (letters, combining marks, joiners), its simple lower case, its script's number (0: other)."""
    n = 0x110000
    letter = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
    inside = letter.copy()
    inside[[i for i in range(n) if unicodedata.category(chr(i))[0] == "M"]] = True
    inside[[0x200C, 0x200D]] = True
    lower = np.arange(n, dtype=np.uint32)
    for i in np.flatnonzero(letter):
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    script = np.zeros(n, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return letter, inside, lower, script


@dataclass(frozen=True)
class Words:
    """Letter runs of some texts: which trigram each letter is, where each word starts among the letters, its length, text and script."""

    trigram: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    script: np.ndarray


def words_of(texts: list[str], buckets: int) -> Words:
    letter, inside, lower, scripts = _unicode()
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(inside[codes])
    if len(at):  # runs without a letter are no words
        run = np.cumsum(np.concatenate(([0], np.diff(at) > 1)))
        at = at[np.bincount(run, weights=letter[codes[at]])[run] > 0]
    low = np.zeros(len(codes), np.uint64)
    low[at] = lower[codes[at]]
    if not len(at):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, empty, empty, empty)
    before = np.where(at > 0, low[np.maximum(at - 1, 0)], 0)
    with np.errstate(over="ignore"):
        h = before * np.uint64(0x9E3779B97F4A7C15) + low[at] * np.uint64(0xC2B2AE3D27D4EB4F) + low[at + 1] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    trigram = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    length = np.diff(np.concatenate((first, [len(at)])))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return Words(trigram, first, length, np.searchsorted(ends, at[first], side="right"), scripts[codes[at[first]]].astype(np.int64))


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    table: np.ndarray  # log P(trigram | language): buckets x languages
    allowed: np.ndarray  # scripts x languages
    switch: float

    def scores(self, words: Words) -> np.ndarray:
        s = np.add.reduceat(self.table[words.trigram], words.start, axis=0).astype(np.float64)
        return s + np.where(self.allowed[words.script], 0.0, BLOCKED * words.length[:, None])

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language of each word under the switching penalty."""
        n, k = s.shape
        best = int(np.argmax(s.sum(0)))
        if k == 1:
            return np.zeros(n, np.int64)
        # What any other labelling gains over `best` is at most the sum of its words' gains; a stretch that gains no more than one
        # switch costs can't pay, so if no stretch does, `best` all through is the Viterbi path.
        gain = np.concatenate(([0.0], np.cumsum(s.max(1) - s[:, best])))
        if gain[-1] <= self.switch or (gain - np.minimum.accumulate(gain)).max() <= self.switch:
            return np.full(n, best)
        back = []
        v = s[0].tolist()
        for row in s[1:].tolist():
            top = max(v)
            arg = v.index(top)
            jump = top - self.switch
            back.append([i if v[i] >= jump else arg for i in range(k)])
            v = [max(v[i], jump) + row[i] for i in range(k)]
        out = np.empty(n, np.int64)
        out[-1] = at = v.index(max(v))
        for i in range(n - 2, -1, -1):
            out[i] = at = back[i][at]
        return out

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and spans (first word, words, language) of each text."""
        out: list = [(UNKNOWN, 0.0, [])] * len(texts)
        words = words_of(texts, len(self.table))
        if not len(words.start) or not self.langs:
            return out
        s = self.scores(words)
        cut = np.flatnonzero(np.concatenate(([True], np.diff(words.text) > 0)))
        for a, b in zip(cut, [*cut[1:], len(s)], strict=True):
            path = self.path(s[a:b])
            length = words.length[a:b]
            share = np.bincount(path, weights=length, minlength=len(self.langs))
            win = int(np.argmax(share))
            total = s[a:b].sum(0)
            sure = 1.0 / np.exp(np.clip(total - total[win], -700, 50)).sum()
            turn = np.flatnonzero(np.concatenate(([True], np.diff(path) != 0)))
            spans = [(int(i), int(j - i), self.langs[path[i]]) for i, j in zip(turn, [*turn[1:], len(path)], strict=True)]
            out[words.text[a]] = (self.langs[win], float(share[win] / length.sum() * (sure if len(spans) == 1 else 1.0)), spans)
        return out


def blocks(texts: list[str], limit: int = BLOCK):
    """Slices of texts with about limit code points each, one text at least."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if texts:
        yield slice(first, len(texts))


def train(docs: DataFrame, max_docs: int = 20_000, switch: float = 12.0) -> LanguageModel:
    """Learns from the columns text and lang of docs (doc_id only chooses the sample of about max_docs rows).

    Only counts come to the driver: buckets x languages, CELLS at most.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sample = hash_sample(rows, max_docs, rows.count(), "doc_id").select("text", "lang")
    langs = tuple(sorted(r[0] for r in sample.select("lang").distinct().collect()))
    if not langs:
        return LanguageModel((), np.zeros((1, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool), switch)
    buckets = min(BUCKETS, CELLS // len(langs))
    n_scripts = len(SCRIPTS) + 1

    def count(batches):
        for pdf in batches:
            for lang, group in pdf.groupby("lang", sort=False):
                texts = group["text"].tolist()
                for b in blocks(texts):
                    w = words_of(texts[b], buckets)
                    n = np.bincount(w.trigram, minlength=buckets)
                    used = np.bincount(w.script, weights=w.length, minlength=n_scripts)
                    i, j = np.flatnonzero(n), np.flatnonzero(used)
                    yield pd.DataFrame({"lang": lang, "cell": np.concatenate((i, buckets + j)), "n": np.concatenate((n[i], used[j].astype(np.int64)))})

    counted = map_pandas(sample, count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((buckets + n_scripts, len(langs)))
    table[counted["cell"], counted["lang"].map({x: i for i, x in enumerate(langs)})] = counted["n"]
    grams, scripts = table[:buckets] + 0.5, table[buckets:]
    allowed = scripts > 0.001 * scripts.sum(0)
    allowed |= ~allowed.any(1)[:, None]
    return LanguageModel(langs, np.log(grams / grams.sum(0)).astype(np.float32), allowed, switch)


RESULT = T.StructType([
    T.StructField("lang_pred", T.StringType()),
    T.StructField("lang_score", T.DoubleType()),
    T.StructField("lang_spans", T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("lang", T.StringType())]))),
])


def label(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_spans; no shuffle. The model is broadcast: at most CELLS floats."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    bound_batches(docs.sparkSession)

    @F.pandas_udf(RESULT)
    def predict(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for column in columns:
                texts = [t if t is not None else "" for t in column]
                found = [x for b in blocks(texts) for x in shared.value.label(texts[b])]
                yield pd.DataFrame({"lang_pred": [x[0] for x in found], "lang_score": [x[1] for x in found], "lang_spans": [[{"first_word": a, "n_words": n, "lang": k} for a, n, k in x[2]] for x in found]})
        finally:
            release_memory()

    out = [c for c in docs.columns if c.lower() not in RESULT.fieldNames()]
    return docs.withColumn("_lang", predict(F.col(text))).select(*out, *[F.col(f"_lang.{c}").alias(c) for c in RESULT.fieldNames()])
