"""Benchmark decontamination by latent semantic retrieval.

1. Every whole text becomes the sequence of its words' numbers in the
   benchmark's vocabulary (0: another word), written once.
2. Passages are overlapping windows of a document; their TF-IDF vectors over
   the vocabulary's rarer terms form a matrix of which a distributed
   randomised SVD finds the leading right singular vectors: tasks add up
   A^T (A X) and (A Q)^T (A Q), which are as large as the vocabulary only.
3. Passages and benchmark items are compared by cosine in the latent space;
   the benchmark is searched in blocks of items that the space has room for.
   Of items that it holds badly (``KEPT``, or fewer than ``ITEM_TERMS`` terms),
   candidates are also the stretches with their rarest words: a stretch that
   holds enough of an item holds some.
4. A candidate counts if the longest common subsequence of words covers the
   item nearly whole, or, for a paraphrase, most of it while the item's answer
   stands there word by word: its last sentence, or what ``answer_words`` takes
   where that is a word or two or nearly the whole item.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh, materialise, narrow, only_cache, short_batches

#: Words of half a passage; passages overlap by half.
HALF = 32
#: Rank, and further random directions of the range finder.
RANK, OVERSAMPLE = 128, 16
#: Terms in a larger share of half passages are left out of the matrix, except
#: the rarest terms of each item.
MAX_SHARE, ITEM_TERMS = 0.003, 8
COSINE = 0.3
#: Share of an item's words in common order: nearly whole; paraphrase.
NEAR, PARAPHRASE = 0.8, 0.6
#: Words of an answer at least.
ANSWER = 4
#: Items shorter than this must occur word by word.
SHORT = 6
#: An item's latent vector has this share of the norm of its own at least, or
#: the item is looked up by its rarest words.
KEPT = 0.3
#: Benchmark items searched at once, about two for each dimension; a larger
#: benchmark takes several rounds.
BLOCK_ITEMS = 256
SEED = 17
#: An item of n words is looked at where n // RARE_HITS of its rare words stand.
RARE_HITS = 5
#: Matrix entries worked on at once, so that products stay in cache.
CHUNK = 8192
#: Documents worked on at once.
ROWS = 256
#: Words looked up at once in the index of rare words.
LOOKUP = 1 << 16

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        return 0


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def answer_words(text: str) -> int:
    """How many of the item's last words are its answer.  The last sentence,
    if it has ``ANSWER`` words and an edited item can hold it whole (less than
    ``NEAR`` of the item); else the last sentences that have ``ANSWER`` words
    together, if they are at most half of the item; else its last quarter, and
    ``ANSWER`` words at least."""
    lengths = [n for n in (len(words(s)) for s in _SENTENCE.split(text)) if n]
    n = sum(lengths)
    if ANSWER <= lengths[-1] < NEAR * n:
        return lengths[-1]
    joined = 0
    while joined < ANSWER and lengths:
        joined += lengths.pop()
    return joined if ANSWER <= joined <= n / 2 else min(n, max(ANSWER, -(-n // 4)))


@dataclass
class Items:
    """Benchmark items as number sequences; the query set of a round."""

    ids: list[int | None]
    sequences: list[list[int]]
    answers: list[list[int]]
    vocabulary: dict[str, int]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Items:
        numbers: dict[str, int] = {}
        number = lambda w: numbers.setdefault(w, len(numbers) + 1)
        ids, sequences, answers = [], [], []
        for item_id, text in rows:
            sequence = [number(w) for w in words(text)]
            if not sequence:
                continue
            ids.append(item_id)
            sequences.append(sequence)
            answers.append(sequence[-answer_words(text):])
        return cls(ids, sequences, answers, numbers)

    @property
    def kind(self):
        return np.uint16 if len(self.vocabulary) < 1 << 16 else np.uint32


def numbered(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the number sequence of each whole text, written once."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(items.vocabulary)
    kind = items.kind

    def run(batches):
        only_cache()
        number = _Numbers(vocabulary.value).__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, out = batch.slice(at, ROWS), []
                for text in part.column("text"):
                    found = words(text.as_py())
                    out.append(np.fromiter(map(number, found), kind, len(found)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "s"])

    rows = narrow(docs, doc_id=id_col, text=text_col)
    return materialise(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, s binary"),
                       "decontaminate-numbers")


# --- passages -------------------------------------------------------------

def _joined(sequences: list[np.ndarray]):
    """All numbers in a row, the half passage of each, halves per sequence."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    halves = -(-lengths // HALF)
    first = np.cumsum(halves) - halves
    flat = np.concatenate([*sequences, np.zeros(0, np.int64)]).astype(np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return flat, np.repeat(first, lengths) + at // HALF, halves


def half_frequencies(sequences: list[np.ndarray], terms: int) -> tuple[np.ndarray, int]:
    """In how many half passages each term occurs, and how many there are."""
    flat, half, halves = _joined(sequences)
    used = flat > 0
    pairs = np.sort(half[used] * terms + flat[used])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:] != pairs[:-1]
    return np.bincount(pairs[new] % terms, minlength=terms), int(halves.sum())


@dataclass
class Matrix:
    """Rows of TF-IDF passages: terms and weights, row starts, and where each
    row's passage lies (sequence, first half)."""

    terms: np.ndarray
    weights: np.ndarray
    starts: np.ndarray
    sequence: np.ndarray
    half: np.ndarray

    def chunks(self) -> Iterator[tuple[slice, np.ndarray]]:
        """(entries, their row starts) of about CHUNK entries, whole rows."""
        at = 0
        while at < len(self.starts):
            end = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + CHUNK)))
            last = self.starts[end] if end < len(self.starts) else len(self.terms)
            yield slice(int(self.starts[at]), int(last)), self.starts[at:end] - self.starts[at]
            at = end

    def times(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """A x, in chunks: (entries, row starts, product)."""
        for part, starts in self.chunks():
            y = x[self.terms[part]]
            y *= self.weights[part, None]
            yield part, starts, np.add.reduceat(y, starts, axis=0)


def passages(sequences: list[np.ndarray], idf: np.ndarray) -> Matrix:
    """TF-IDF rows of windows of two neighbouring halves (a sequence of one
    half is one window); windows without a weighted term have no row."""
    flat, half, halves = _joined(sequences)
    used = idf[flat] > 0
    flat, half = flat[used], half[used]
    total, owner = int(halves.sum()), np.repeat(np.arange(len(halves)), halves)
    begins = np.zeros(total + 1, bool)
    begins[np.cumsum(halves)[halves > 0] - halves[halves > 0]] = True
    # a half lies in the window that begins with it and in the one before; the
    # window that begins with a sequence's last half adds nothing unless it is
    # the only one
    ends = np.zeros(total, bool)
    ends[np.cumsum(halves)[halves > 0] - 1] = True
    own = ~(ends & ~begins[:total])[half] if total else np.zeros(0, bool)
    before = ~begins[half]
    window = np.concatenate([half[own], half[before] - 1])
    term = np.concatenate([flat[own], flat[before]])
    terms = len(idf)
    pairs, tf = np.unique(window * terms + term, return_counts=True)
    window, term = pairs // terms, pairs % terms
    starts = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else np.zeros(0, np.int64)
    rows = window[starts]
    first = np.cumsum(halves) - halves
    sequence = owner[rows] if len(rows) else np.zeros(0, np.int64)
    return Matrix(term, ((1 + np.log(tf)) * idf[term]).astype(np.float32), starts, sequence,
                  rows - first[sequence] if len(rows) else rows)


def _item_passages(items: Items, idf: np.ndarray) -> tuple[Matrix, np.ndarray]:
    """Items as rows: a passage's length at most, so that a window of a
    document can hold one; which item each piece belongs to."""
    pieces, owner = [], []
    for i, s in enumerate(items.sequences):
        for at in range(0, max(1, len(s) - HALF), HALF):
            end = len(s) if at + 2 * HALF >= len(s) - HALF // 2 else at + 2 * HALF
            pieces.append((i, s[at:end]))
            if end == len(s):
                break
    term, weight, starts = [], [], []
    for i, piece in pieces:
        terms, tf = np.unique([w for w in piece if idf[w] > 0], return_counts=True)
        if len(terms):
            starts.append(sum(map(len, term)))
            term.append(terms.astype(np.int64))
            weight.append((1 + np.log(tf)) * idf[terms.astype(np.int64)])
            owner.append(i)
    none = np.zeros(0, np.int64)
    return Matrix(np.concatenate([none, *term]), np.concatenate([none, *weight]).astype(np.float32),
                  np.array(starts, np.int64), none, none), np.array(owner, np.int64)


# --- randomised SVD -------------------------------------------------------

def _normal(matrix: Matrix, x: np.ndarray) -> np.ndarray:
    """A^T (A x)."""
    out = np.zeros_like(x)
    for part, starts, y in matrix.times(x):
        terms = matrix.terms[part]
        row = np.zeros(len(terms), np.int64)
        row[starts[1:]] = 1
        row = np.cumsum(row)
        order = np.argsort(terms, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(terms[order]) > 0]))
        back = y[row[order]]
        back *= matrix.weights[part][order, None]
        out[terms[order][first]] += np.add.reduceat(back, first, axis=0)
    return out


def _gram(matrix: Matrix, q: np.ndarray) -> np.ndarray:
    """(A q)^T (A q)."""
    out = np.zeros((q.shape[1], q.shape[1]))
    for _, _, y in matrix.times(q):
        out += y.T @ y
    return out


def _summed(seqs: DataFrame, shape: tuple[int, int], per_batch, rows_per_block: int = 1024) -> np.ndarray:
    """Sum over all documents of a matrix that each task makes for its own:
    blocks of rows are added up in Spark, one group per block, in two steps,
    and only the sum comes to the driver."""
    blocks = [(i, min(i + rows_per_block, shape[0])) for i in range(0, shape[0], rows_per_block)]

    def run(batches):
        only_cache()
        total = None
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                part = per_batch([np.frombuffer(s, _kind) for s in pdf.s.iloc[at:at + ROWS]])
                total = part.astype(np.float64) if total is None else total + part
        if total is not None:
            mine = TaskContext.get().partitionId() % 64  # the same if the task runs again
            yield pd.DataFrame({"block": range(len(blocks)), "part": mine,
                                "v": [total[a:b].tobytes() for a, b in blocks]})

    _kind = per_batch.kind

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf.v.iloc[0]) // 8)
        for v in pdf.v:
            total += np.frombuffer(v, np.float64)
        return pd.DataFrame({"block": pdf.block.iloc[:1], "v": [total.tobytes()]})

    parts = seqs.select("s").mapInPandas(run, "block long, part long, v binary")
    some = parts.groupBy("block", "part").applyInPandas(add, "block long, v binary")
    out = np.zeros(shape)
    for r in some.groupBy("block").applyInPandas(add, "block long, v binary").collect():
        a, b = blocks[r.block]
        out[a:b] = np.frombuffer(r.v, np.float64).reshape(b - a, shape[1])
    return out


class _Job:
    """A function of a list of sequences, with their number type."""

    def __init__(self, kind, fn):
        self.kind, self._fn = kind, fn

    def __call__(self, sequences):
        return self._fn(sequences)


@dataclass
class LatentSpace:
    """Weights per term and the leading right singular vectors."""

    idf: np.ndarray
    vectors: np.ndarray
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))


def term_weights(counts: np.ndarray, halves: int, items: Items) -> np.ndarray:
    """Square-root inverse half-passage frequency, 0 for terms left out."""
    keep = (counts <= MAX_SHARE * halves)
    for s in items.sequences:
        terms = np.unique(s)
        keep[terms[np.argsort(counts[terms], kind="stable")][:ITEM_TERMS]] = True
    keep[0] = False
    return np.where(keep, np.sqrt(max(halves, 1) / np.maximum(counts, 1)), 0.0)


def fit(seqs: DataFrame, items: Items, rank: int = RANK, seed: int = SEED) -> LatentSpace:
    """Randomised SVD over the passages of all documents and all items."""
    terms, kind, sc = len(items.vocabulary) + 1, items.kind, seqs.sparkSession.sparkContext

    def frequencies(sequences):
        counts, halves = half_frequencies(sequences, terms)
        counts[0] = halves  # term 0 is no term: its place holds the number of halves
        return counts[:, None]

    counts = _summed(seqs, (terms, 1), _Job(kind, frequencies))[:, 0]
    counts, halves = counts.copy(), int(counts[0])
    own, more = half_frequencies([np.asarray(s) for s in items.sequences], terms)
    counts += own
    idf = term_weights(counts, halves + more, items)
    item_rows, _ = _item_passages(items, idf)
    width = min(rank + OVERSAMPLE, terms)
    start = np.random.default_rng(seed).normal(size=(terms, width)).astype(np.float32)
    shared = sc.broadcast((idf, start))
    y = _summed(seqs, start.shape, _Job(kind, lambda s: _normal(passages(s, shared.value[0]), shared.value[1])))
    q = np.linalg.qr(y + _normal(item_rows, start))[0].astype(np.float32)
    basis = sc.broadcast((idf, q))
    gram = _summed(seqs, (q.shape[1], q.shape[1]), _Job(kind, lambda s: _gram(passages(s, basis.value[0]), basis.value[1])))
    values, u = np.linalg.eigh(gram + _gram(item_rows, q))
    top = np.argsort(values)[::-1][:rank]
    return LatentSpace(idf, (q @ u[:, top]).astype(np.float32), np.sqrt(np.maximum(values[top], 0)), counts)


# --- search and check -----------------------------------------------------

def common_subsequence(masks: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence of a pattern of ``n`` words,
    given as bit masks of its words' places, and another sequence: one step of
    bit arithmetic per word."""
    full = (1 << n) - 1
    v = full
    for w in other:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _masks(sequence: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(sequence):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _places(sequence: list[int], part: list[int]) -> list[int]:
    """Where ``part`` stands word by word."""
    n, first = len(part), part[0]
    return [i for i, w in enumerate(sequence[:max(0, len(sequence) - n + 1)]) if w == first and sequence[i:i + n] == part]


def _contains(sequence: list[int], part: list[int]) -> bool:
    return bool(_places(sequence, part))


def window_words(n: int) -> list[int]:
    """Words of the windows that are checked for an item of n: a quarter more,
    then twice as many for an item with words put in between.  Evenly spread,
    0.8 of it fit into the wider one up to about 140 % of words put in."""
    return [n] if n < SHORT else [n + -(-n // 4), 2 * n]


class RareWords:
    """Where a document can hold an item, whatever its cosine.  A window that
    has ``need`` of an item's n words in order misses n - need of them, so of
    any n - need + k it has k: the index holds that many of each item's rarest,
    and a stretch is a candidate for k hits within a window's length.  Only
    items of ``indexed`` are in the index; ``possible`` knows all."""

    def __init__(self, items: Items, counts: np.ndarray, share: float = PARAPHRASE, indexed=None):
        self._k, self._width = np.zeros(len(items.ids), np.int64), np.zeros(len(items.ids), np.int64)
        self._rare: list[frozenset[int]] = []
        term, owner = [], []
        for i, sequence in enumerate(items.sequences):
            n, s = len(sequence), np.asarray(sequence)
            need = n if n < SHORT else min(n, math.ceil(share * n - 1e-9))
            k = max(1, min(need, n // RARE_HITS))
            rare = np.unique(s[np.argsort(counts[s], kind="stable")[:n - need + k]])
            self._rare.append(frozenset(rare.tolist()))
            self._k[i], self._width[i] = k, window_words(n)[-1]
            if indexed is None or i in indexed:
                term.append(rare)
                owner.append(np.full(len(rare), i))
        self._any = np.zeros(len(items.vocabulary) + 1, bool)
        self._any[list(frozenset().union(*self._rare))] = True
        none = np.zeros(0, np.int64)
        term, owner = np.concatenate([none, *term]), np.concatenate([none, *owner])
        self._items = owner[np.argsort(term, kind="stable")]
        per_term = np.bincount(term, minlength=len(items.vocabulary) + 1)
        self._starts = np.concatenate([[0], np.cumsum(per_term)])

    def possible(self, item: int, rare_words: list[int]) -> bool:
        """Whether a stretch has the rare words that it needs, in any order;
        only those that ``rare_places`` keeps need be given."""
        return sum(map(self._rare[item].__contains__, rare_words)) >= self._k[item]

    def rare_places(self, sequence: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Where words stand that are rare in some item, and the words."""
        at = np.flatnonzero(self._any[sequence])
        return at, sequence[at].tolist()

    def stretches(self, sequences: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(sequence, item, begin, end), stretches of an item that touch as one."""
        if not len(self._items):
            return
        lengths = np.array([len(s) for s in sequences], np.int64)
        gap = 2 * int(self._width.max())  # so that no stretch reaches the next sequence
        first = np.cumsum(lengths + gap) - lengths - gap
        flat = np.concatenate([*sequences, np.zeros(0, np.int64)]).astype(np.int64)
        used = np.flatnonzero(self._starts[flat + 1] > self._starts[flat])
        place = np.repeat(first - np.cumsum(lengths) + lengths, lengths)[used] + used
        flat = flat[used]
        found = []
        for at in range(0, len(flat), LOOKUP):
            stop = int(np.searchsorted(place, place[min(at + LOOKUP, len(flat)) - 1] + gap))
            begin = self._starts[flat[at:stop]]
            many = self._starts[flat[at:stop] + 1] - begin
            entry = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
            item, where = self._items[entry], np.repeat(place[at:stop], many)
            order = np.argsort(item, kind="stable")
            item, where = item[order], where[order]
            last = np.arange(len(item)) + self._k[item] - 1
            ok = np.flatnonzero(last < len(item))
            ok = ok[(item[last[ok]] == item[ok]) & (where[last[ok]] - where[ok] < self._width[item[ok]])]
            found.append(np.stack([item[ok], where[ok]]))
        if not found:
            return
        item, where = np.unique(np.concatenate(found, axis=1), axis=1)
        if not len(item):
            return
        width = self._width[item]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (where[1:] - where[:-1] >= 2 * width[1:])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(item)) - 1
        for i, begin, end, w in zip(item[a].tolist(), where[a].tolist(), where[b].tolist(), width[a].tolist()):
            n = int(np.searchsorted(first, begin, side="right")) - 1
            yield n, i, max(0, begin - w + 1 - int(first[n])), min(end + w - int(first[n]), int(lengths[n]))


class Checker:
    """Decides whether a stretch of a document holds an item."""

    def __init__(self, items: Items, near: float = NEAR, paraphrase: float = PARAPHRASE):
        self._items, self._near, self._paraphrase = items, near, paraphrase
        self._mask = [_masks(s) for s in items.sequences]

    def check(self, item: int, stretch: list[int]) -> tuple[float, str] | None:
        """(share of the item in common order, kind), or None.  A paraphrase is
        the best of the windows that hold the item's answer word by word."""
        s, masks = self._items.sequences[item], self._mask[item]
        n = len(s)
        if n < SHORT:
            return (1.0, "exact") if _contains(stretch, s) else None
        answer = self._items.answers[item]
        stands = _places(stretch, answer)
        hits = [0, *accumulate(map(masks.__contains__, stretch))]
        best, step = 0, max(1, n // 8)  # windows an eighth of the item apart
        answered, least = 0, self._paraphrase * n
        for width in window_words(n):
            for at in range(0, max(1, len(stretch) - width + step), step):
                end = min(at + width, len(stretch))
                holds = stands and any(at <= a <= end - len(answer) for a in stands)
                if hits[end] - hits[at] >= (max(least, answered + 1) if holds else max(self._near * n, best + 1)):
                    length = common_subsequence(masks, n, stretch[at:end])
                    best = max(best, length)
                    if holds:
                        answered = max(answered, length)
            if best / n >= self._near:
                return best / n, "near"
        return (answered / n, "paraphrase") if answered >= max(1, least) else None


def _cosine(sequence: np.ndarray, begin: int, end: int, queries: np.ndarray, space: LatentSpace) -> float:
    """Largest latent cosine of the passages that touch a stretch."""
    matrix, best, row = passages([sequence], space.idf), 0.0, 0
    for _, _, y in matrix.times(space.vectors):
        at = matrix.half[row:row + len(y)] * HALF
        y = y[(at < end) & (at + 2 * HALF > begin)]
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        best = max(best, float((y @ queries.T).max(initial=0.0)))
        row += len(at)
    return best


def _joined_candidates(pairs: np.ndarray, cosines: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """(sequence, item, begin, end, cosine) of candidate stretches, those of
    one sequence and item that overlap as one with their largest cosine.
    ``pairs`` has columns sequence, item, begin, end."""
    if not len(pairs):
        return
    order = np.lexsort((pairs[:, 3], pairs[:, 2], pairs[:, 1], pairs[:, 0]))
    pairs, cosines = pairs[order], cosines[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:, :2] != pairs[:-1, :2]).any(1)
    group = np.cumsum(new)  # ends so far, kept apart by group
    reach = np.maximum.accumulate(pairs[:, 3] + group * (1 << 40)) - group * (1 << 40)
    new[1:] |= pairs[1:, 2] > reach[:-1]
    first = np.flatnonzero(new)
    yield from zip(pairs[first, 0].tolist(), pairs[first, 1].tolist(), pairs[first, 2].tolist(),
                   np.maximum.reduceat(pairs[:, 3], first).tolist(), np.maximum.reduceat(cosines, first).tolist())


def search(seqs: DataFrame, items: Items, space: LatentSpace, cosine: float = COSINE,
           near: float = NEAR, paraphrase: float = PARAPHRASE, kept: float = KEPT, item_type: str = "long") -> DataFrame:
    """doc_id, item_id, cosine, share, kind of all passages that hold an item;
    one row per document and item of a row of ``seqs``.

    Candidates are the passages of cosine ``cosine`` or more, and of items
    that the space keeps less than ``kept`` of, or that have hardly a term,
    also the stretches that their rarest words lead to.  Candidates of one item that overlap are one, so
    every stretch is checked once."""
    rows, owner = _item_passages(items, space.idf)
    latent = [y for _, _, y in rows.times(space.vectors)]
    queries = np.concatenate(latent) if latent else np.zeros((0, space.vectors.shape[1]), np.float32)
    norms = np.linalg.norm(queries, axis=1)
    own = np.sqrt(np.add.reduceat(rows.weights.astype(np.float64) ** 2, rows.starts)) if len(owner) else norms
    share = np.zeros(len(items.ids))  # an item without a weighted term has no vector: nothing is kept
    np.maximum.at(share, owner, 1.0)
    np.minimum.at(share, owner, norms / np.maximum(own, 1e-12))
    queries /= np.maximum(norms[:, None], 1e-12)
    for i, s in enumerate(items.sequences):  # a vector of few terms says little beside a passage's others
        if np.count_nonzero(space.idf[np.unique(s)]) < ITEM_TERMS:
            share[i] = 0.0
    rare = RareWords(items, space.counts, min(near, paraphrase), set(np.flatnonzero(share < kept).tolist()))
    shared = seqs.sparkSession.sparkContext.broadcast((items, space, queries, owner, rare))
    key = seqs.schema["doc_id"].dataType.simpleString()
    kind = to_arrow_type(seqs.sparkSession.createDataFrame([], f"item_id {item_type}").schema["item_id"].dataType)

    def run(batches):
        only_cache()
        items, space, queries, owner, rare = shared.value
        checker = Checker(items, near, paraphrase)
        widths = np.array([window_words(len(s))[-1] for s in items.sequences], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sequences = [np.frombuffer(s.as_py(), items.kind) for s in part.column("s")]
                lengths = np.array([len(s) for s in sequences], np.int64)
                matrix, row = passages(sequences, space.idf), 0
                pairs, cosines = [], []
                for _, _, y in matrix.times(space.vectors):
                    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                    c = y @ queries.T
                    r, q = np.nonzero(c >= cosine)
                    item, i = owner[q], matrix.sequence[row + r]
                    # the passage, and all windows that reach into it
                    begin, reach = matrix.half[row + r] * HALF, widths[item] - 1
                    pairs.append(np.stack([i, item, np.maximum(0, begin - reach),
                                           np.minimum(lengths[i], begin + 2 * HALF + reach)], 1))
                    cosines.append(c[r, q])
                    row += len(y)
                more = list(rare.stretches(sequences))
                pairs.append(np.array(more, np.int64).reshape(-1, 4))
                cosines.append(np.full(len(more), -1.0))
                best: dict[tuple[int, int], tuple] = {}
                of = -1
                for i, item, begin, end, value in _joined_candidates(np.concatenate(pairs), np.concatenate(cosines)):
                    known = best.get((i, item))
                    if known is not None and known[2] == "near" and known[1] == 1.0:
                        continue
                    if i != of:
                        of, (places, rare_words) = i, rare.rare_places(sequences[i])
                    a, b = places.searchsorted((begin, end)).tolist()
                    if not rare.possible(item, rare_words[a:b]):
                        continue
                    found = checker.check(item, sequences[i][begin:end].tolist())
                    if found and (known is None or found[0] > known[1]):
                        if value < 0:
                            value = _cosine(sequences[i], begin, end, queries[owner == item], space)
                        best[i, item] = (value, *found)
                if best:
                    ids = part.column("doc_id").take(pa.array([i for i, _ in best], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([items.ids[item] for _, item in best], kind),
                         *(pa.array(c, t) for c, t in zip(zip(*best.values()), (pa.float64(), pa.float64(), pa.string())))],
                        ["doc_id", "item_id", "cosine", "share", "kind"])

    return seqs.mapInArrow(run, f"doc_id {key}, item_id {item_type}, cosine double, share double, kind string")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", rank: int = RANK,
                 block_items: int = BLOCK_ITEMS, cosine: float = COSINE, kept: float = KEPT) -> DataFrame:
    """doc_id, item_id, cosine, share, kind: which documents hold which items.

    * null, empty or wordless texts and items hold and match nothing
    * items with a null id are searched like any other; their matches have a
      null item_id, one row per document for all of them (the best share)
    * an item of a few words is found word by word
    * ``cosine`` is that of the passage, also where it is below ``COSINE`` and
      the item's rare words led to it
    * equal items are found each, rows of equal id and text once; repeated rows
      of a document give one row per document and item (the best share)
    * an empty table on either side: no rows; further columns are not carried;
      ids of both sides are of any type
    * a benchmark of any size: about ``block_items`` items are searched at a
      time, whatever their ids, and only they are on the driver
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = narrow(benchmark, item_id=item_id_col, text=item_text_col).where("text IS NOT NULL AND text != ''").distinct()
    n = rows.count()
    key, item_type = docs.schema[id_col].dataType.simpleString(), rows.schema["item_id"].dataType.simpleString()
    found = [spark.createDataFrame([], f"doc_id {key}, item_id {item_type}, cosine double, share double, kind string")]
    blocks = -(-n // block_items)
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        items = Items.of([(r.item_id, r.text) for r in block])
        if items.ids:
            seqs = numbered(docs, items, id_col, text_col)
            found.append(materialise(search(seqs, items, fit(seqs, items, rank), cosine, kept=kept, item_type=item_type),
                                     "decontaminate-found"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("share", "cosine", "kind")).alias("m")).select(
        "doc_id", "item_id", "m.cosine", "m.share", "m.kind")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, row by row:
    a row goes for its own text, whatever its id (null, or that of other rows).
    All columns are kept."""
    md5 = fresh(docs, "md5")
    hashed = docs.withColumn(md5, F.md5(F.col(f"`{text_col}`")))
    out = materialise(contaminated(hashed, benchmark, id_col=md5, text_col=text_col)
                      .select(F.col("doc_id").alias(md5)).distinct(), "decontaminate-dropped")
    return hashed.join(out, md5, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
