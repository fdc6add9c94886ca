"""SentencePiece encoding and decoding: N-best segmentation over the piece lattice of a public model.

A text is cut where no piece of the model crosses: before each run of spaces, and between letters and other characters, so its lattice is
a chain of word lattices. In each, a forward Viterbi pass gives the best score to every position; these scores are the exact heuristic of
a backward A* search, which yields the word's segmentations best first. Texts' N best follow by A* over the words' ranked losses. The
Viterbi pass runs once for each distinct word of a block of texts, all words of the block side by side; nothing is kept from block to block.

Scores are log-probabilities. A model that carries them gives its own. A model of merges carries ranks only, which are no
likelihoods; its piece of rank r then has the probability of Zipf's law with Mandelbrot's offset, 1 / (r + 2.7) over the sum of these,
r being the piece's place in the vocabulary. Nothing is trained. A character without a piece falls back to its bytes, at a penalty below
every piece, as one edge. Decoding joins pieces, turns runs of byte pieces into text and marks into spaces, and gives the text
back exactly; the mark itself occurring in a text is encoded by its bytes.

Defined cases: a null or empty text has no pieces and score 0; N beyond what a text allows gives all there are; ties go to the longer
last piece, among equal segmentations of a word to the one found first, among words to the earlier; repeated rows are encoded alike; an
empty table gives no rows; columns of the input named like the output are replaced. Decoding takes any ids: byte pieces that make no UTF-8
become U+FFFD, control pieces and ids out of range give nothing, and only a leading space is taken off; null ids give null.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections import defaultdict
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

MARK = "▁"
PENALTY, GRAIN = 10.0, 1 << 20
#: Mandelbrot's offset to the rank.
OFFSET = 2.7
#: Characters of texts, and of distinct words, that a task works on at once.
BLOCK, WORDS = 1 << 20, 1 << 17
#: Longer words are segmented one by one.
LONG = 48
INF = float("inf")

#: At which of the best ids it begins, how many of them it replaces, and by what.
Change = tuple[int, int, tuple[int, ...]]


def changed(ids: list[int], changes: list[Change]) -> list[int]:
    """Another segmentation of a text, from its best one."""
    out, at = [], 0
    for start, n, new in changes:
        out += [*ids[at:start], *new]
        at = start + n
    return out + list(ids[at:])


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] of them), then those of the next."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) - np.repeat(before - start, length)


class Trie:
    """All pieces as a trie whose moves are rows of a hash table, for many positions at once."""

    SEED = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, int]):
        nodes: dict[tuple[int, int], int] = {}
        last: list[int] = [-1]
        for piece, i in pieces.items():
            at = 0
            for c in map(ord, piece):
                at = nodes.setdefault((at, c), len(nodes) + 1)
                if at == len(last):
                    last.append(-1)
            last[at] = i
        self.piece = np.array(last, np.int32)  # the piece that ends at a node, or -1
        keys = np.array([(a << 21) | c for a, c in nodes], np.int64)
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.to = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        for key, slot, node in zip(keys.tolist(), self._slots(keys).tolist(), nodes.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % size
            self.keys[slot], self.to[slot] = key, node

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * self.SEED) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node after each node's character; 0 where there is none."""
        key = (node.astype(np.int64) << 21) | code
        slot = self._slots(key)
        met = self.keys[slot]
        out = np.where(met == key, self.to[slot], 0)
        left = np.flatnonzero((met != key) & (met >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.keys)
            met = self.keys[slot[left]]
            hit = met == key[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (met >= 0)]
        return out


class Best:
    """The best segmentation of each of some words: score, loss (what the second choice costs more, infinite if there is none), and ids."""

    def __init__(self, n: int):
        self.score, self.loss = np.zeros(n), np.full(n, INF)
        self.count = np.zeros(n, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # words, and their ids one after another

    def close(self) -> None:
        self.first = np.cumsum(self.count) - self.count
        self.ids = np.empty(int(self.count.sum()), np.int32)
        for words, ids in self.parts:
            self.ids[_ranges(self.first[words], self.count[words])] = ids
        self.parts = []

    def of(self, word: int) -> np.ndarray:
        return self.ids[self.first[word] : self.first[word] + self.count[word]]


class Pieces:
    """The pieces of a SentencePiece model file with their log-probabilities."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bytes = [-1] * 256
        self.raw: list[bytes] = []
        named: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.raw.append(b"")
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                named[piece.replace(MARK, " ")] = i
                self.raw[i] = piece.replace(MARK, " ").encode()
        own = [model.get_score(i) for i in named.values()]
        if all(s == int(s) for s in own):  # ranks, not log-probabilities
            whole = math.log(sum([1.0 / (r + OFFSET) for r in range(1, len(own) + 1)]))
            own = [-math.log(r + OFFSET) - whole for r in range(1, len(own) + 1)]
        # Whole multiples of a power of two add up without rounding, so equal segmentations tie exactly, in whatever order they are summed.
        self.scores = {p: (round(s * GRAIN) / GRAIN, (i,)) for (p, i), s in zip(named.items(), own, strict=True)}
        self.fallback = round((min(own, default=0.0) - PENALTY) * GRAIN) / GRAIN
        self.longest = max(map(len, named), default=1)
        self.single = {p for p in named if len(p) == 1}

    @cached_property
    def trie(self) -> Trie:
        return Trie({p: ids[0] for p, (_, ids) in self.scores.items()})

    @cached_property
    def score_of(self) -> np.ndarray:
        """By id, and -inf at the end."""
        out = np.full(len(self.raw) + 1, -INF)
        for s, ids in self.scores.values():
            out[ids[0]] = s
        return out

    @cached_property
    def words(self):
        """Cuts a text: letter runs and runs of others, each with the spaces before it. Letters that a piece joins to others count as others."""
        others: set[str] = set()
        while True:
            letter = re.compile(r"[^\W\d_]") if not others else re.compile(r"[^\W\d_" + "".join(map(re.escape, sorted(others))) + "]")
            more = {c for p in self.scores for a, b in itertools.pairwise(p) if " " not in (a, b) and bool(letter.match(a)) != bool(letter.match(b)) for c in (a, b) if letter.match(c)}
            if not more:
                break
            others |= more
        assert not any(" " in p.lstrip(" ") for p in self.scores), "a piece goes on after a space"
        run = letter.pattern
        return re.compile(rf" *{run}+| *(?:(?!{run})[^ ])+| +").findall

    def edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each position, the edges that begin there: end, score, ids."""
        n = len(word)
        out = []
        for i in range(n):
            here = [(j, *self.scores[word[i:j]]) for j in range(i + 1, min(n, i + self.longest) + 1) if word[i:j] in self.scores]
            if word[i] not in self.single:
                here.append((i + 1, self.fallback, tuple([self.bytes[b] for b in word[i].encode()])))
            out.append(here)
        return out

    def best(self, word: str) -> tuple[float, float, list[int]]:
        """Score, loss and ids of one word, by a forward Viterbi pass."""
        n = len(word)
        best, gap, last = [0.0] + [-INF] * n, [INF] * (n + 1), [None] * (n + 1)
        for i, here in enumerate(self.edges(word)):
            for j, s, ids in here:  # an earlier beginning is a longer last piece, so it wins a tie
                v = best[i] + s
                if v > best[j]:
                    gap[j], best[j], last[j] = v - best[j], v, (i, ids)
                else:
                    gap[j] = min(gap[j], best[j] - v)
        # The second choice comes into the best path at one of its nodes, by that node's second edge.
        at, loss, parts = n, INF, []
        while at:
            loss = min(loss, gap[at])
            at, ids = last[at]
            parts.append(ids)
        return best[n], loss, [i for ids in reversed(parts) for i in ids]

    def segment(self, words: list[str]) -> Best:
        """The best segmentation of each word; short words go side by side."""
        out = Best(len(words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-length, kind="stable")
        order = order[length[order] <= LONG]
        slow = [np.flatnonzero(length > LONG)]
        for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(length[order]) // WORDS)) + 1):
            if len(part):
                slow.append(self._side_by_side([words[w] for w in part.tolist()], part, length[part], out))
        for w in np.concatenate(slow).tolist():
            out.score[w], out.loss[w], ids = self.best(words[w])
            out.count[w] = len(ids)
            out.parts.append((np.array([w]), np.array(ids, np.int32)))
        out.close()
        return out

    def _side_by_side(self, words: list[str], place: np.ndarray, length: np.ndarray, out: Best) -> np.ndarray:
        """Viterbi over words of falling length, all at their step t at once. Returns the places of words that need bytes, which are left out."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        begin = np.cumsum(length) - length
        size = len(codes)
        longest = min(self.longest, int(length[0]))
        none = len(self.raw)
        # piece[l - 1][i]: the piece of l characters that begins at i.
        piece = np.full((longest, size), none, np.int32)
        going, node = np.arange(size), np.zeros(size, np.int32)
        end = np.repeat(begin + length, length)
        for l in range(longest):
            node = self.trie.step(node, codes[going + l])
            found = self.trie.piece[node]
            piece[l, going[found >= 0]] = found[found >= 0]
            stay = (node > 0) & (going + l + 1 < end[going])
            going, node = going[stay], node[stay]
            if not len(going):
                break
        whole = np.minimum.reduceat(piece[0] < none, begin)
        bytes_needed = place[~whole]
        place, begin, length = place[whole], begin[whole], length[whole]
        if not len(place):
            return bytes_needed
        score = self.score_of
        # By node, which is named by the character before it: best score, loss against the second edge, and the best edge's length and piece.
        best, gap = np.empty(size), np.empty(size)
        took, by = np.empty(size, np.int64), np.empty(size, np.int32)
        alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        for t, n in enumerate(alive.tolist()):
            at = begin[:n] + t
            top, second = np.full(n, -INF), np.full(n, -INF)
            took_now, by_now = np.zeros(n, np.int64), np.zeros(n, np.int32)
            for l in range(min(longest, t + 1), 0, -1):
                p = piece[l - 1, at - l + 1]
                v = score[p]
                if l <= t:
                    v = v + best[at - l]
                better = v > top
                second = np.maximum(second, np.where(better, top, v))
                top = np.where(better, v, top)
                took_now, by_now = np.where(better, l, took_now), np.where(better, p, by_now)
            best[at], took[at], by[at] = top, took_now, by_now
            gap[at] = top - second
        out.score[place] = best[begin + length - 1]
        # Back from the end of each word.
        left, row, loss = length.copy(), np.arange(len(place)), np.full(len(place), INF)
        steps = []
        while len(row):
            at = begin[row] + left[row] - 1
            loss[row] = np.minimum(loss[row], gap[at])
            steps.append((row, by[at]))
            left[row] -= took[at]
            row = row[left[row] > 0]
        out.loss[place] = loss
        count = np.zeros(len(place), np.int64)
        for row, _ in steps:
            count[row] += 1
        first = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int32)
        for k, (row, pieces) in enumerate(steps):
            ids[first[row] + count[row] - 1 - k] = pieces
        out.count[place] = count
        out.parts.append((place, ids))
        return bytes_needed

    def ranked(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a word, best first: forward Viterbi, then A* from the end."""
        ending: list[list] = [[] for _ in range(len(word) + 1)]
        for i, here in enumerate(self.edges(word)):
            for j, s, ids in here:
                ending[j].append((i, s, ids))
        forward = [0.0] * len(ending)
        for j in range(1, len(ending)):
            forward[j] = max([forward[i] + s for i, s, _ in ending[j]])
        # Behind is what has been taken, and the forward score is exactly the best of what is still to come.
        queue = [(-forward[-1], 0, len(word), 0.0, None)]
        out: list = []
        k = 0
        while queue and len(out) < n:
            total, _, at, behind, path = heapq.heappop(queue)
            if not at:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((-total, tuple(ids)))
                continue
            for i, s, taken in ending[at]:
                k -= 1  # of equal ones the last goes first, which is the deepest: ties never widen the search
                heapq.heappush(queue, (-(forward[i] + s + behind), k, i, s + behind, (taken, path)))
        return out

    def others(self, base: float, n: int, losses: np.ndarray, start, word) -> list[tuple[float, list[Change]]]:
        """The second to n-th best segmentations of a text as (score, changes), by A* over its words' ranked losses.

        losses: of each of its words; start(w): where word w begins among the best ids; word(w): its ranked segmentations.
        """
        # Only the n - 1 words whose second choice loses least can be changed in the n best.
        losses = losses.copy()
        order: list[int] = []
        while len(order) < n - 1 and len(losses) and losses[w := int(np.argmin(losses))] < INF:
            order.append(w)
            losses[w] = INF
        choices = {w: word(w) for w in order}
        begun = {w: start(w) for w in order}

        def loss(k: int, c: int) -> float:
            return choices[order[k]][0][0] - choices[order[k]][c][0]

        out: list = []
        queue = [(loss(0, 1), (0,), (1,))] if order else []
        while queue and len(out) < n - 1:
            cost, which, choice = heapq.heappop(queue)
            out.append((base - cost, sorted([(begun[order[k]], len(choices[order[k]][0][1]), choices[order[k]][c][1]) for k, c in zip(which, choice, strict=True)])))
            k, c = which[-1], choice[-1]
            if c + 1 < len(choices[order[k]]):  # a worse choice for the last changed word
                heapq.heappush(queue, (cost - loss(k, c) + loss(k, c + 1), which, (*choice[:-1], c + 1)))
            if k + 1 < len(order):
                more = loss(k + 1, 1)
                heapq.heappush(queue, (cost + more, (*which, k + 1), (*choice, 1)))  # one word more
                if c == 1:
                    heapq.heappush(queue, (cost - loss(k, 1) + more, (*which[:-1], k + 1), choice))  # another word instead
        return out

    def block(self, texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[list[Change]]]]:
        """Of some texts: the ids of the best segmentations one after another, how many each has, scores of the n best, changes of each of the others.

        A segmentation has the model's leading space before the text.
        """
        number: dict[str, int] = defaultdict(itertools.count().__next__)
        each = [np.array([number[w] for w in self.words(" " + t)] if t else [], np.int64) for t in texts]
        names = list(number)
        best = self.segment(names)
        told: dict[int, list] = {}

        def ranked(w: int) -> list:
            # The best one is the forward pass's, which settles ties.
            if w not in told:
                own = tuple(best.of(w).tolist())
                ways = self.ranked(names[w], n + 1)
                told[w] = [(ways[0][0], own), *[x for x in ways if x[1] != own]][:n]
            return told[w]

        ids, sizes, scores, changes = [], [], [], []
        for words in each:
            count = best.count[words]
            ids.append(best.ids[_ranges(best.first[words], count)])
            sizes.append(len(ids[-1]))
            base = float(best.score[words].sum())
            more = self.others(base, n, best.loss[words], lambda w, count=count: int(count[:w].sum()), lambda w, words=words: ranked(int(words[w]))) if n > 1 else []
            scores.append([base, *[s for s, _ in more]])
            changes.append([c for _, c in more])
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(sizes, np.int64), scores, changes

    def n_best(self, text: str, n: int) -> tuple[list[int], list[tuple[float, list[Change]]]]:
        """The best ids, and the n best segmentations as (score, changes to the best ids)."""
        ids, _, scores, changes = self.block([text], n)
        return ids.tolist(), list(zip(scores[0], [[], *changes[0]], strict=True))

    @cached_property
    def _buffer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces' bytes, and where each id's begin and how many there are; the last id stands for all out of range."""
        raw = [*self.raw, b""]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length) - length, length

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        data, first, length = self._buffer
        ids = np.where((ids >= 0) & (ids < len(self.raw)), ids, len(self.raw))
        return data[_ranges(first[ids], length[ids])].tobytes().decode("utf-8", "replace").removeprefix(" ")


@lru_cache(2)
def load(model_file: str) -> Pieces:
    return Pieces(model_file)


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


CHANGES = "array<array<struct<start:int,n:int,ids:array<int>>>>"


def _parts(batch: pa.RecordBatch, size: pa.Array):
    """Parts of a batch with about BLOCK of the size."""
    size = pc.fill_null(size, 0).to_numpy(zero_copy_only=False)
    cut = [0, *(np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // BLOCK)) + 1).tolist(), batch.num_rows]
    for a, b in itertools.pairwise(cut):
        yield batch.slice(a, b - a)


def _added(df: DataFrame, taken: list[str], new: str) -> tuple[DataFrame, list[int], T.StructType, list[str]]:
    """df without columns named like the new ones, the places of the columns taken, and the schema and names of the output."""
    more = T.StructType.fromDDL(new)
    names = {f.lower() for f in more.fieldNames()}
    kept = [c for c in df.columns if c.lower() not in names]
    narrow = df.select(*[F.col(f"`{c}`") for c in kept])
    places = [next(i for i, c in enumerate(kept) if c.lower() == x) for x in taken]
    return narrow, places, T.StructType([*narrow.schema.fields, *more.fields]), [*kept, *more.fieldNames()]


def encode(docs: DataFrame, n: int = 4, model_file: str | None = None) -> DataFrame:
    """docs with ids (array<int>, the best segmentation), scores (of the n best) and changes (of each of the others, see changed). No shuffle.

    Rows are taken and given out in parts of about BLOCK characters, so a batch of long texts is never held with all its segmentations.
    """
    file = model_file or default_model()
    narrow, (place,), schema, names = _added(docs, ["text"], f"ids array<int>, scores array<double>, changes {CHANGES}")

    def run(batches):
        pieces = load(file)
        change = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            for part in _parts(batch, pc.utf8_length(batch.column(place))):
                ids, sizes, scores, changes = pieces.block([t or "" for t in part.column(place).to_pylist()], n)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                told = [[[{"start": i, "n": k, "ids": x} for i, k, x in c] for c in row] for row in changes]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(scores, pa.list_(pa.float64())), pa.array(told, pa.list_(pa.list_(change)))], names=names)

    return map_arrow(narrow, run, schema)


def decode(encoded: DataFrame, ids: str = "ids", model_file: str | None = None) -> DataFrame:
    """encoded with decoded: the text of the ids; null ids give null."""
    file = model_file or default_model()
    narrow, (place,), schema, names = _added(encoded, [ids.lower()], "decoded string")

    def run(batches):
        pieces = load(file)
        for batch in batches:
            for part in _parts(batch, pc.list_value_length(batch.column(place))):
                texts = [None if x is None else pieces.decode(x) for x in _lists(part.column(place))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return map_arrow(narrow, run, schema)


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    """The lists of numbers of a column; a null number is -1."""
    values = pc.fill_null(column.values, -1).to_numpy(zero_copy_only=False)
    offsets, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], there, strict=True)]


def round_trips(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """encoded with round_trips: for each of a row's n segmentations, built and decoded whole, if it gives the column text back."""
    file = model_file or default_model()
    narrow, (text, ids, changes), schema, names = _added(encoded, ["text", "ids", "changes"], "round_trips array<boolean>")

    def run(batches):
        pieces = load(file)
        for batch in batches:
            for part in _parts(batch, pc.list_value_length(batch.column(ids))):
                out = []
                for t, best, others in zip(part.column(text).to_pylist(), _lists(part.column(ids)), part.column(changes).to_pylist(), strict=True):
                    tried = [best]
                    for c in others:
                        cut, at = [], 0
                        for x in c:
                            cut += [best[at : x["start"]], np.array(x["ids"], best.dtype)]
                            at = x["start"] + x["n"]
                        tried.append(np.concatenate([*cut, best[at:]]))
                    out.append([pieces.decode(x) == (t or "") for x in tried])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.bool_()))], names=names)

    return map_arrow(narrow, run, schema)
