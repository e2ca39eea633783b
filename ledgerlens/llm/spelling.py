"""Spelling variants: words one insertion, deletion or replacement apart,
found by pivotal grams.

1. ``word_counts``: tasks count the words of whole texts, Spark adds up.
2. Bigrams are ordered globally, rarest first (over the distinct words).  A
   word's prefix are its first ``2 * 1 + 1 = 3`` bigrams in that order, with
   all further ones that tie with the last.  Its pivots are two disjoint
   bigrams of the prefix with the least total frequency, chosen by dynamic
   programming.
3. One edit leaves one of two disjoint bigrams whole.  Of two near words let
   ``s`` be that whose prefix ends first: its surviving pivot is a bigram of
   the other, no later than the end of that one's prefix, so it lies in it.
   So pivots are looked up among the prefixes of words whose prefix ends no
   earlier.  The position limit is exact: if the edit is behind the left
   pivot, that stands at the same place from the left, and everything before
   it is the same; otherwise the right pivot stands at the same place from the
   right, and everything behind it is the same.  Of the part on the edit's
   side one half is the same, too.  The join's key is a hash of the bigram with
   its place, the other word's length, and these equal parts.
4. Every candidate is verified by the Levenshtein distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, narrow, only_cache, short_batches

GRAM, EDITS = 2, 1
#: Least code points and occurrences of a word; how much more frequent a
#: word's form is; one run of so many is thinned by a letter.
MIN_CHARS, MIN_COUNT, FORM_RATIO, THINNED = 7, 2, 10, 31
#: Distinct words that a task counts before it sends them on, and the bytes
#: of a text that it looks at in one go.
HELD_WORDS, SLICE_BYTES = 300_000, 1 << 20

#: Runs in UTF-8 after lower-casing A-Z: a-z, and U+00C0-U+00FF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_BLANK = re.compile(rb"[^a-z\x80-\xff]")


def slices(data: bytes, stop: re.Pattern, size: int = SLICE_BYTES):
    """Consecutive parts of ``data``, each cut behind the first match of
    ``stop`` (a single byte) after ``size`` bytes."""
    at = 0
    while len(data) - at > size:
        found = stop.search(data, at + size)
        if not found:
            break
        yield data[at:found.end()]
        at = found.end()
    yield data[at:] if at else data


def thinned(run: bytes, start: int, one_in: int = THINNED) -> bytes:
    """The run; if ``one_in`` divides the CRC-32 of ``<doc_id>:<run>``, without
    the code point whose index is the CRC-32 modulo the length.  ``start`` is
    the CRC-32 of ``<doc_id>:``."""
    h = zlib.crc32(run, start)
    if h % one_in:
        return run
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1:]).encode()


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of whole texts with their occurrences.

    * null text: no words; a null id is written ``null`` in the hashed string
    * repeated rows count again; tasks count first, so frequent words do not
      gather; empty table: no rows
    """
    def run(batches):
        only_cache()
        counts: Counter = Counter()

        def out():
            words = [(w, n) for r, n in counts.items() if len(w := r.decode()) >= min_chars]
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], ["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                runs: Counter = Counter()
                for part in slices((text.as_py() or "").encode().lower(), _BLANK):
                    runs.update(_RUN.findall(part))
                start = zlib.crc32(f"{'null' if i is None else i}:".encode())
                for r, n in runs.items():
                    if len(r) >= min_chars:  # bytes, at least as many as code points
                        counts[thinned(r, start)] += n
                if len(counts) > HELD_WORDS:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    short_batches(docs.sparkSession)
    rows = narrow(docs, doc_id=id_col, text=text_col)
    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Words' bigrams with their place in the global order: by the number of
    places they occur at, then by text.  The alphabet of ``word_counts`` has 90
    letters, so there are 8,100 at most."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - (GRAM - 1)))
    counts = (words.where(F.length("word") >= GRAM).select("word", at.alias("i"))
              .groupBy(F.expr(f"substring(word, i, {GRAM})").alias("gram"))
              .agg(F.count(F.lit(1)).alias("places")).collect())
    return {r.gram: (k, r.places) for k, r in enumerate(sorted(counts, key=lambda r: (r.places, r.gram)))}


def pivots(grams: list[tuple[int, int]], weights: list[int], k: int = EDITS + 1) -> list[int]:
    """Indexes of ``k`` disjoint grams with the least total weight; ``grams``
    are (place, rank) in ascending order of place.  None if there are not as
    many.

    ``best[j][i]``: the least weight of ``j`` disjoint grams among the first
    ``i``, with the last index taken and the number of grams before it."""
    n = len(grams)
    none = float("inf")
    best = [[(0, ())] * (n + 1)] + [[(none, ())] * (n + 1) for _ in range(k)]
    for i in range(1, n + 1):
        before = i - 1  # grams that end before this one begins
        while before and grams[before - 1][0] + GRAM > grams[i - 1][0]:
            before -= 1
        for j in range(1, k + 1):
            w, taken = best[j - 1][before]
            best[j][i] = min(best[j][i - 1], (w + weights[i - 1], (*taken, i - 1)))
    return list(best[k][n][1])


def _key(side: int, half: int, place: int, size: int, equal: str) -> int:
    return xxhash.xxh64_intdigest(f"{side}{half} {place} {size} {equal}") - (1 << 63)


def _keys(word: str, side: int, place: int, size: int) -> tuple[int, int]:
    """The keys under which ``word`` (for ``side`` 1 spelled backwards) meets a
    word of ``size`` code points by its bigram at ``place``, with the edit
    behind that bigram: all up to it is the same, and of what the other word
    has behind it the first half, or else the last (but for one, which the
    edit may have added)."""
    end = place + GRAM
    half = (size - end) // 2
    last = size - end - 1 - half
    tail = word[len(word) - last:] if last > 0 else ""
    return (_key(side, 0, place, size, word[:end + half]), _key(side, 1, place, size, f"{word[:end]} {tail}"))


def index_entries(word: str, ranks: dict) -> tuple[list[int], list[int], int]:
    """(keys of the pivots for all sizes of the other word, keys of the
    prefix, rank of the prefix' last gram)."""
    size, back = len(word), word[::-1]
    places = sorted((ranks[word[i:i + GRAM]][0], i) for i in range(size - GRAM + 1))
    last = places[min(GRAM * EDITS + 1, len(places)) - 1][0]
    prefix = sorted((i, r) for r, i in places if r <= last)
    left, right = (prefix[c][0] for c in pivots(prefix, [ranks[word[i:i + GRAM]][1] for i, _ in prefix]))
    mine, others = [], []
    for other in range(size - EDITS, size + EDITS + 1):
        mine += _keys(word, 0, left, other)
        mine += _keys(back, 1, size - GRAM - right, other)
    for i, _ in prefix:
        others += _keys(word, 0, i, size)
        others += _keys(back, 1, size - GRAM - i, size)
    return mine, others, last


def near_pairs(words: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """word, n, other, other_n: all pairs of ``words`` (word, n; as
    ``word_counts`` gives them, of at least ``min_chars`` >= 4 code points, so
    that each has two disjoint bigrams in its prefix) with exactly one edit
    between them, each once."""
    spark = words.sparkSession
    if min_chars < GRAM * EDITS + GRAM:
        raise ValueError("words need at least four code points")
    ranks = spark.sparkContext.broadcast(gram_ranks(words))

    def run(batches):
        only_cache()
        known = ranks.value
        for batch in batches:
            keys: list[int] = []
            sizes, lasts = [], []
            words_, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for word in words_:
                mine, others, last = index_entries(word, known)
                keys += mine
                keys += others
                sizes += (len(mine), len(others))
                lasts.append(last)
            sizes = np.array(sizes, np.int64)
            row = np.repeat(np.arange(len(words_)), sizes.reshape(-1, 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column("word").take(pa.array(row)), pa.array(counts[row]),
                 pa.array(np.array(lasts, np.int32)[row]),
                 pa.array(np.repeat(np.arange(len(sizes)) % 2 == 0, sizes))], ["key", "word", "n", "last", "pivot"])

    short_batches(spark)
    entries = materialise(words.mapInArrow(run, "key long, word string, n long, last int, pivot boolean"),
                          "spelling-index")

    def side(pivot: bool, tag: str) -> DataFrame:
        return entries.where(F.col("pivot") == pivot).select(
            "key", F.col("word").alias(f"w{tag}"), F.col("n").alias(f"n{tag}"), F.col("last").alias(f"last{tag}"))

    found = (side(True, "1").join(side(False, "2"), "key")
             .where((F.col("last1") <= F.col("last2")) & (F.col("w1") != F.col("w2"))
                    & (F.levenshtein("w1", "w2", EDITS) == EDITS)))
    swap = F.col("w1") > F.col("w2")
    return found.select(
        F.when(swap, F.col("w2")).otherwise(F.col("w1")).alias("word"),
        F.when(swap, F.col("n2")).otherwise(F.col("n1")).alias("n"),
        F.when(swap, F.col("w1")).otherwise(F.col("w2")).alias("other"),
        F.when(swap, F.col("n1")).otherwise(F.col("n2")).alias("other_n")).distinct()


def roots(forms: DataFrame, most: int, ratio: int = FORM_RATIO) -> DataFrame:
    """word, root: the last word on the way from each ``word`` of ``forms``
    (word, form) over forms.  Every step multiplies the occurrences by
    ``ratio`` at least, so ``most`` (the greatest) bounds the steps, and half
    of those that remain are taken in each round."""
    if ratio < 2:
        raise ValueError("a form must be more frequent")
    steps, reach = 1, 1
    while ratio ** (steps + 1) <= most:
        steps += 1
    at = forms.select("word", F.col("form").alias("root"))
    while reach < steps:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = materialise(at.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")),
                         "spelling-roots")
        reach *= 2
    return at


def variant_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of the documents (see
    ``word_counts``), the near word with most occurrences if it has ``ratio``
    times the word's (ties: the smallest in code-point order), the last word
    that forms lead to, and the number of near words.

    Empty table: no rows; further columns of ``docs`` are not read."""
    words = materialise(word_counts(docs, id_col=id_col, text_col=text_col, min_chars=min_chars,
                                    min_count=min_count), "spelling-words")
    pairs = near_pairs(words, min_chars)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                          F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("order"), F.col("other").alias("form"), F.col("n")))
    near = materialise(
        both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_b"))
        .select("word", "n_near", F.when(-F.col("_b.order") >= ratio * F.col("_b.n"),
                                         F.struct(F.col("_b.form").alias("form"),
                                                  (-F.col("_b.order")).alias("form_n"))).alias("_f")), "spelling-near")
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(near.where("_f IS NOT NULL").select("word", "_f.form"), most, ratio)
    return (words.join(near, "word", "left").join(ends, "word", "left")
            .select("word", F.col("_f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("_f.form_n").alias("form_n")))
