"""Hidden Markov language model over words.

Tokens are words, A-Z lower-cased, and one end. Each token belongs to a class: the FREQUENT most frequent training tokens are classes of their own,
and the others share classes by a hash of their last letters and shape. Latent states emit classes, classes emit tokens:

    P(token | state) = P(class | state) * (c + 0.5) / (N_class + 0.5 * (V_class + 1))

with c, N_class and V_class counted over all training texts; an unseen token has c = 0 in its class. A class of one token emits it surely.
States start from the company that classes keep: counts of each class beside the most frequent ones, over all training texts, are clustered.
They are trained by Baum-Welch: expected counts are summed over partitions, every iteration over all training texts. A text's likelihood is
exact, by the scaled forward recursion over all its tokens. Texts of a batch run side by side, the longest first.

What is gathered grows with the corpus: the table of token counts is a shuffled table, joined to the tokens by word. Only tables of
bounded size are broadcast: KNOWN counts of frequent words, and states x classes numbers.

Defined cases: a null text is empty and has the end only; with no training text all tokens are unseen and the base is log10(1) each for N = V = 0;
repeated rows are scored alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_pandas, write_shared

#: The end of a text; no word is empty.
END = ""
FREQUENT, SHARED = 2048, 2048
#: Frequent words whose counts each task holds; the others' counts are joined.
KNOWN = 1 << 16
STATES, ITERATIONS = 8, 4
#: Frequent classes that tell of a class by standing before and after it, and how far off they may stand.
BESIDE, NEAR = 32, 4
#: Tokens that are worked on at once.
BLOCK = 1 << 20
PRIOR = 0.01


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def shared_class(word: bytes) -> int:
    """The class of a word that has none of its own: by its last three bytes and its length; words, numbers and other strings apart."""
    kind = (3 if word.isdigit() else 2 if word.isascii() and not word.isalpha() else 1) * 8 + min(len(word).bit_length(), 7)
    h = (int.from_bytes(word[-3:], "little") * 64 + kind) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return FREQUENT + (h >> 32) % SHARED


class Classes(dict):
    """word -> class; own: the words with a class of their own, in order. Other words are added as they are met, up to a bound."""

    MOST = 1 << 19

    def __init__(self, own: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(own))
        self.own = own

    def __missing__(self, word: bytes) -> int:
        k = self[word] = shared_class(word)
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.MOST:
            self.clear()
            self.update((w, i) for i, w in enumerate(self.own))
        return np.fromiter(map(self.__getitem__, words), np.uint16, len(words))


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states

    @classmethod
    def first(cls, totals: np.ndarray, group: np.ndarray, states: int) -> Hmm:
        """Each class is emitted mostly by the state of its group, and states last."""
        emit = (totals[:, None] + PRIOR) * np.where(group[:, None] == np.arange(states), 1.0, 0.02)
        return cls(np.full(states, 1.0 / states), np.full((states, states), 0.2 / states) + 0.8 * np.eye(states), emit / emit.sum(0))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
        start, move, emit = start + PRIOR, move + PRIOR, emit + PRIOR
        return cls(start / start.sum(), move / move.sum(1)[:, None], emit / emit.sum(0))

    def forward(self, sequences: list[np.ndarray]) -> np.ndarray:
        """The natural logarithm of each sequence's probability."""
        shown, begin, alive, order = _by_step(sequences)
        out = np.zeros(len(sequences))
        alpha = np.tile(self.start, (len(order), 1))
        for t, n in enumerate(alive):
            now = alpha[:n] * self.emit[shown[begin[t] : begin[t] + n]]
            scale = now.sum(1)
            out[:n] += np.log(scale)
            alpha = (now / scale[:, None]) @ self.move
        back = np.empty_like(out)
        back[order] = out
        return back

    def expect(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch: expected counts of first states, moves, and emissions."""
        shown, begin, alive, order = _by_step(sequences)
        states = len(self.start)
        alphas, seen = np.empty((len(shown), states)), np.empty((len(shown), states))
        alpha = np.tile(self.start, (len(order), 1))
        for t, n in enumerate(alive):
            at = slice(begin[t], begin[t] + n)
            emitted = self.emit[shown[at]]
            now = alpha[:n] * emitted
            scale = now.sum(1)[:, None]
            np.divide(now, scale, out=alphas[at])
            np.divide(emitted, scale, out=seen[at])
            alpha = alphas[at] @ self.move
        move = np.zeros((states, states))
        back = self.move.T.copy()
        beta = np.ones((len(order), states))
        for t in range(len(alive) - 1, 0, -1):
            n = alive[t]
            right = seen[begin[t] : begin[t] + n] * beta[:n]
            before = alphas[begin[t - 1] : begin[t - 1] + n]
            move += before.T @ right
            np.matmul(right, back, out=beta[:n])
            before *= beta[:n]  # now the state's probability given the whole sequence
        start = alphas[: len(order)].sum(0) if len(shown) else np.zeros(states)
        weights = alphas.T.copy()
        emit = np.stack([np.bincount(shown, weights=w, minlength=len(self.emit)) for w in weights], 1)
        return start, move * self.move, emit


def _by_step(sequences: list[np.ndarray]) -> tuple[np.ndarray, list[int], list[int], np.ndarray]:
    """All tokens, step by step and the longest sequence first in each; where each step begins, how many are alive in it, and the order.

    No sequence is empty, for each has its end.
    """
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    order = np.argsort(-lengths, kind="stable")
    ordered = lengths[order]
    alive = np.searchsorted(-ordered, -np.arange(lengths.max(initial=0)), side="left")
    begin = np.cumsum(alive) - alive
    shown = np.empty(lengths.sum(), np.int64)
    for rank, k in enumerate(order.tolist()):
        shown[begin[: lengths[k]] + rank] = sequences[k]
    return shown, begin.tolist(), alive.tolist(), order


def count_tokens(docs: DataFrame, training: Column) -> DataFrame:
    """word, c: how often each token occurs in training texts, in the shared folder. Counts are summed in each batch of texts, then in each task."""

    def run(batches):
        for pdf in batches:
            n: Counter[bytes] = Counter()
            for text in pdf["text"]:
                n.update(tokens(text))
            yield pd.DataFrame({"word": [w.decode("utf-8", "surrogatepass") for w in n], "c": list(n.values())})

    rows = map_pandas(docs.where(training).select("text"), run, "word string, c long")
    return write_shared(rows.groupBy("word").agg(F.sum("c").alias("c")), "token-counts")


def class_totals(counts: DataFrame, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """N and V of each class; each task sends its nonzero classes."""
    shared = counts.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        classes = Classes(shared.value)
        n, v = np.zeros(FREQUENT + SHARED), np.zeros(FREQUENT + SHARED)
        for pdf in batches:
            k = classes.of([w.encode("utf-8", "surrogatepass") for w in pdf["word"]])
            n += np.bincount(k, weights=pdf["c"], minlength=len(n))
            v += np.bincount(k, minlength=len(v))
        k = np.flatnonzero(v)
        yield pd.DataFrame({"k": k, "n": n[k], "v": v[k]})

    rows = map_pandas(counts, run, "k int, n double, v double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()
    n, v = np.zeros(FREQUENT + SHARED), np.zeros(FREQUENT + SHARED)
    n[rows["k"]], v[rows["k"]] = rows["n"], rows["v"]
    return n, v


def _sequences(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column]


def _parts(sequences: list[np.ndarray], limit: int = BLOCK) -> list[np.ndarray]:
    """The sequences in parts of about limit tokens. Those of like length are together, for a part takes as many steps as its longest has tokens."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    order = np.argsort(-lengths, kind="stable")
    cut = np.flatnonzero(np.diff(np.cumsum(lengths[order]) // limit)) + 1
    return [part for part in np.split(order, cut) if len(part)]


def _summed(encoded: DataFrame, size: int, add) -> np.ndarray:
    """size numbers, which add(sequences) gives for some texts, summed over all rows of encoded. Each task sends its sums, whatever its rows."""

    def run(batches):
        total = np.zeros(size)
        for pdf in batches:
            sequences = _sequences(pdf["classes"])
            for p in _parts(sequences):
                total += add([sequences[i] for i in p])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    rows = map_pandas(encoded.select("classes"), run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[rows["at"]] = rows["n"]
    return out


def groups_of(beside: np.ndarray, weight: np.ndarray, states: int, seed: int = 5) -> np.ndarray:
    """k-means of classes by the square roots of their shares of company (beside: classes x companions); weight: how often each class occurs."""
    rng = np.random.default_rng(seed)
    x = np.sqrt(beside / np.maximum(beside.sum(1, keepdims=True), 1.0))
    weight = weight * (beside.sum(1) > 0)
    if not weight.sum():
        return np.arange(len(x)) % states
    centre = x[[int(weight.argmax())]]
    for _ in range(states - 1):
        far = ((x[:, None, :] - centre) ** 2).sum(2).min(1) * weight
        chosen = rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else int(weight.argmax())
        centre = np.concatenate((centre, x[[chosen]]))
    for _ in range(20):
        group = ((x[:, None, :] - centre) ** 2).sum(2).argmin(1)
        for k in range(states):
            if weight[group == k].sum() > 0:
                centre[k] = np.average(x[group == k], axis=0, weights=weight[group == k])
    return group


def train(encoded: DataFrame, totals: np.ndarray, states: int = STATES, iterations: int = ITERATIONS) -> Hmm:
    """Baum-Welch over the column classes of all rows of encoded."""
    spark = encoded.sparkSession
    kinds = len(totals)

    def company(sequences: list[np.ndarray]) -> np.ndarray:
        # The most frequent classes come first, for classes of their own are in order of their counts.
        flat = np.concatenate(sequences).astype(np.int64)
        text = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
        out = np.zeros(kinds * 2 * BESIDE)
        for far in range(1, NEAR + 1):
            same = text[far:] == text[:-far]
            a, b = flat[:-far][same], flat[far:][same]
            before, after = a < BESIDE, b < BESIDE
            out += np.bincount(np.concatenate((b[before] * 2 * BESIDE + a[before], a[after] * 2 * BESIDE + BESIDE + b[after])), minlength=len(out))
        return out

    beside = _summed(encoded, kinds * 2 * BESIDE, company).reshape(kinds, 2 * BESIDE)
    model = Hmm.first(totals, groups_of(beside, totals, states), states)
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(model)
        flat = _summed(encoded, states + states * states + model.emit.size, lambda seqs, shared=shared: np.concatenate([x.ravel() for x in shared.value.expect(seqs)]))
        model = Hmm.of_counts(flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(model.emit.shape))
    return model


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of each row; training: a condition on doc_id."""
    spark = docs.sparkSession
    counts = count_tokens(docs, training)
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), *[F.count_if(F.col("c") >= (1 << k)).alias(f"above{k}") for k in range(63)]).first()
    n_train, v_train = whole["n"] or 0, whole["v"]
    # Frequent is what occurs at least 2^k times, for the least k that leaves at most KNOWN words: no task sends more than its share of them.
    least = next(1 << k for k in range(63) if whole[f"above{k}"] <= KNOWN)
    frequent = counts.where(F.col("c") >= least).collect()
    top = sorted(((r["word"].encode("utf-8", "surrogatepass"), r["c"]) for r in frequent), key=lambda x: (-x[1], x[0]))
    own = [w for w, _ in top[:FREQUENT]]
    class_n, class_v = class_totals(counts, own)
    # What a token's (c + 0.5) is divided by, given its class: its own value in a class of one.
    below = class_n + 0.5 * (class_v + 1)
    below[:FREQUENT] = 1.0
    below[: len(own)] = [c + 0.5 for _, c in top[:FREQUENT]]
    tables = spark.sparkContext.broadcast((own, dict(top), np.log10(below)))

    # 1. Each text becomes its classes; frequent words are summed here, and what is left are the words to look up.
    def encode(batches):
        own, known, below = tables.value
        classes = Classes(own)
        log_of = {w: float(np.log10(c + 0.5)) for w, c in known.items()}.get
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = tokens(text)
                k = classes.of(words)
                log_c, n_known, rare, times = 0.0, 0, [], []
                for w, c in Counter(words).items():
                    log = log_of(w)
                    if log is None:
                        rare.append(w.decode("utf-8", "surrogatepass"))
                        times.append(c)
                    else:
                        log_c += log * c
                        n_known += c
                out.append((k.tobytes(), len(words), n_known, log_c, float(below[k].sum()), rare, times))
            frame = pd.DataFrame(out, columns=["classes", "n_tokens", "seen", "log_c", "log_below", "rare", "times"])
            yield pd.concat((pdf[["uid", "doc_id", "training"]].reset_index(drop=True), frame), axis=1)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce(training, F.lit(False)).alias("training"), "text")
    schema = "uid long, doc_id long, training boolean, classes binary, n_tokens long, seen long, log_c double, log_below double, rare array<string>, times array<int>"
    encoded = write_shared(map_pandas(rows, encode, schema), "encoded")

    # 2. The states, from all training texts.
    model = spark.sparkContext.broadcast(train(encoded.where("training"), class_n))

    # 3. The counts of the other words, by a join; a text's sums come together again by its number.
    rare = encoded.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("uid", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    looked = rare.join(counts, "word", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )

    def forward(batches):
        for pdf in batches:
            sequences = _sequences(pdf["classes"])
            log = np.zeros(len(sequences))
            for p in _parts(sequences, 8 * BLOCK):
                log[p] = model.value.forward([sequences[i] for i in p])
            yield pdf.drop(columns="classes").assign(log_states=log / np.log(10.0))

    lighter = "uid long, doc_id long, n_tokens long, seen long, log_c double, log_below double, log_states double"
    scored = map_pandas(encoded.select("uid", "doc_id", "classes", "n_tokens", "seen", "log_c", "log_below"), forward, lighter)
    log_all = F.col("log_c") + F.coalesce("rare_log", F.lit(0.0))
    return scored.join(looked, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("seen") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"), F.lit(int(n_train)).cast("bigint").alias("train_tokens"),
        (log_all - F.col("n_tokens") * F.lit(float(np.log10(n_train + 0.5 * (v_train + 1))))).alias("base_score"),
        (F.col("log_states") + log_all - F.col("log_below")).alias("score"),
    )
