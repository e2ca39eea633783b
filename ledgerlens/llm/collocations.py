"""Collocations: frequent phrases by mergeable Misra-Gries summaries, exact
counts in a second pass, and scores of their cuts.

Pass one.  Tasks hash every phrase (a language's n-gram of 1 to 3 words within
a piece) to 64 bits, add up equal hashes of a slice of the corpus, and deal
them by range of the hash.  The task of a range merges them into one
Misra-Gries summary whose capacity exceeds the range's mass divided by the
threshold: whenever more hashes are held, the count of the largest that has no
room is subtracted from all, which happens to more than ``capacity`` counters
at once, so that in total less than the threshold is ever subtracted from any.
Every phrase that reaches the threshold therefore survives, in memory that the
mass bounds.

Pass two counts the phrases themselves, of those whose hash survived; a filter
of bounded size (a survivor is never missed) tells tasks which, so only these
are written out and shuffled.  Two phrases of one hash only add to a counter
of pass one; pass two keeps them apart, so its counts are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import top_n_per_group
from .common import materialise, narrow, only_cache, short_batches, shuffle_partitions

#: Words of the longest phrase, the threshold, the share of a phrase in a
#: longer one (per cent) that drops it, the length of a language's list.
WORDS, LEAST, INSIDE, TOP = 3, 10, 50, 2000
UNKNOWN = "und"
#: Words of a slice that a task adds up at once; text bytes of a range of
#: hashes (about half a phrase of each byte); hashes of a packed row.
SLICE_WORDS, RANGE_BYTES, PACK = 1_000_000, 32 << 20, 4096
#: Bits of the filter per survivor, and its bounds (32 MB): with more
#: survivors than fit, more phrases are counted and none is lost.
FILTER_BITS, MIN_BITS, MAX_BITS = 16, 1 << 20, 1 << 28
MEMO_WORDS = 400_000
SLICE_BYTES = 1 << 20

_TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0a-\x0d]+|[.,;:!?\x0a-\x0d]")
_STOP = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")
_ENDS = frozenset(b".,;:!?\n\x0b\x0c\r")
_SEGMENT = 32768  # bits of one bitmap of bitmap_construct_agg


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class _Vocabulary(dict):
    """Word -> number of this task, from 1; 0 ends a piece."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = [b""]
        self.hashes: list[int] = [0]
        for end in _ENDS:
            self[bytes([end])] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


class _Slices:
    """The corpus of a task as arrays of word and language numbers, slice by
    slice; the last words of a slice come again before the next one."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.words, self.langs = _Vocabulary(), {}
        self._batches = batches

    def __iter__(self):
        """(word numbers, language numbers, how many of them come again)."""
        ids, langs, again, size = [], [], 0, 0
        for batch in self._batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                lang = self.langs.setdefault(UNKNOWN if lang is None else lang, len(self.langs))
                for part in self._parts((text.as_py() or "").encode().lower()):
                    ids.append(part)
                    langs.append(np.full(len(part), lang, np.int32))
                    size += len(part)
                    if size >= SLICE_WORDS:
                        x, y = np.concatenate(ids), np.concatenate(langs)
                        yield x, y, again
                        ids, langs = [x[1 - WORDS:]], [y[1 - WORDS:]]
                        again = size = len(ids[0])
                        if len(self.words) > MEMO_WORDS:
                            kept = [self.words.words[i] for i in ids[0]]
                            self.words = _Vocabulary()
                            ids = [np.array([self.words[w] if w else 0 for w in kept], np.int32)]
        if size > again:
            yield np.concatenate(ids), np.concatenate(langs), again

    def _parts(self, data: bytes) -> Iterator[np.ndarray]:
        """Word numbers of a text, a megabyte at a time, then an end."""
        at, number = 0, self.words.__getitem__
        while at < len(data):
            found = _STOP.search(data, at + SLICE_BYTES) if len(data) - at > SLICE_BYTES else None
            to = found.end() if found else len(data)
            yield np.fromiter(map(number, _TOKEN.findall(data[at:to])), np.int32)
            at, number = to, self.words.__getitem__
        yield np.zeros(1, np.int32)


def _phrases(slices: _Slices, ids, langs, again: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, first places, hashes) of the phrases that end in the slice
    behind the words that came again."""
    known = np.array(slices.words.hashes, np.uint64)[ids]
    seeds = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in slices.langs), np.uint64, len(slices.langs))
    whole = ids != 0
    for n in range(1, WORDS + 1):
        first = np.arange(max(0, again - n + 1), len(ids) - n + 1)
        if not len(first):
            return
        ok = whole[first]
        for i in range(1, n):
            ok &= whole[first + i]
        first = first[ok]
        h = seeds[langs[first]] + np.uint64(n)
        for i in range(n):
            h = _mix(h) + known[first + i]
        yield n, first, _mix(h)


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Which of ``ranges`` equal parts of the 64-bit space; monotone."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


_PACKED = "g int, part int, mass long, hashes binary, counts binary"


def _summaries(ranges: int):
    """A task's slices as packed counts per range of hashes; a row with part
    0 and the mass comes before them."""
    def rows(hashes, counts):
        out = []
        part = _range(hashes, ranges)
        edges = np.searchsorted(part, np.arange(ranges + 1))
        for g in np.unique(part).tolist():
            a, b = int(edges[g]), int(edges[g + 1])
            out.append((g, 0, int(counts[a:b].sum()), b"", b""))
            for k in range(a, b, PACK):
                s = slice(k, min(k + PACK, b))
                out.append((g, 1, 0, hashes[s].tobytes(), counts[s].astype(np.uint32).tobytes()))
            if len(out) >= 64:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def run(batches):
        only_cache()
        found = _Slices(batches)
        for ids, langs, again in found:
            h = np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h in _phrases(found, ids, langs, again))])
            yield from rows(*np.unique(h, return_counts=True))

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["g", "part", "mass", "hashes", "counts"])


class MisraGries:
    """A mergeable summary of at most ``capacity`` counters.  The true count of
    a key is at most its counter (0 if absent) plus ``error``, and ``error`` at
    most the mass divided by ``capacity + 1``."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add keys with counts, then make room: the largest counter that has
        no room is subtracted from all, those at zero go."""
        all_keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([self.counts, counts]), len(all_keys)).astype(np.int64)
        if len(all_keys) > self.capacity:
            least = int(np.partition(sums, len(sums) - self.capacity - 1)[len(sums) - self.capacity - 1])
            self.error += least
            sums -= least
            all_keys, sums = all_keys[sums > 0], sums[sums > 0]
        self.keys, self.counts = all_keys, sums


def _survivors(least: int):
    """Rows of ranges, each range's masses first -> the hashes that may have
    ``least`` occurrences."""
    def run(batches):
        only_cache()
        at, mass, held, size, summary = None, 0, [], 0, None

        def merge():
            nonlocal held, size
            if held:
                summary.merge(np.concatenate([np.frombuffer(h, np.uint64) for h, _ in held]),
                              np.concatenate([np.frombuffer(c, np.uint32) for _, c in held]).astype(np.int64))
                held, size = [], 0

        def out():
            if summary is None:
                return
            merge()
            keys = summary.keys[summary.counts + summary.error >= least].astype(np.int64)
            for k in range(0, len(keys), PACK):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + PACK])], ["h"])

        for batch in batches:
            for g, part, m, hashes, counts in zip(*(batch.column(c) for c in ("g", "part", "mass", "hashes", "counts"))):
                if g.as_py() != at:
                    yield from out()
                    at, mass, summary = g.as_py(), 0, None
                if part.as_py() == 0:
                    mass += m.as_py()
                    continue
                if summary is None:
                    summary = MisraGries(mass // least + 1)
                held.append((hashes.as_py(), counts.as_py()))
                size += len(held[-1][0]) // 8
                if size >= max(PACK, summary.capacity):
                    merge()
        yield from out()

    return run


def survivors(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """h: 64-bit hashes among which are those of all phrases of ``rows``
    (lang, text) with ``least`` occurrences in their language."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(shuffle_partitions(spark), -(-total // RANGE_BYTES))
    packed = rows.mapInArrow(_summaries(ranges), _PACKED)
    return materialise(packed.repartitionById(ranges, "g").sortWithinPartitions("g", "part")
                       .mapInArrow(_survivors(least), "h long"), "phrase-survivors")


def _filter(found: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the survivors' places, and its bits."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (FILTER_BITS * max(1, found.count()) - 1).bit_length()))
    place = F.shiftrightunsigned(F.col("h"), 64 - (bits.bit_length() - 1))
    parts = (found.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("segment"))
             .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("bitmap")))
    out = np.zeros(max(bits, _SEGMENT) // 8, np.uint8)
    for segment, bitmap in parts.toLocalIterator():
        at = (segment - 1) * (_SEGMENT // 8)
        out[at:at + len(bitmap)] = np.frombuffer(bitmap, np.uint8)
    return out, bits


def _counted(bitmap, bits: int):
    """Phrases whose hash passes the filter, with their words and counts; and
    per language all its words, as phrase null."""
    shift = np.uint64(64 - (bits.bit_length() - 1))

    def run(batches):
        only_cache()
        marked = bitmap.value
        found = _Slices(batches)
        for ids, langs, again in found:
            names = list(found.langs)
            words = np.bincount(langs[again:][ids[again:] != 0], minlength=len(names))
            out = [([names[i] for i in range(len(names))], [None] * len(names), [0] * len(names), words.tolist())]
            for n, first, h in _phrases(found, ids, langs, again):
                at = h >> shift
                first = first[(marked[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                if not len(first):
                    continue
                keys = langs[first].astype(np.int64)
                for i in range(n):  # numbers of the pairs (key so far, next word)
                    _, keys = np.unique(keys << 32 | ids[first + i].astype(np.int64), return_inverse=True)
                _, where, counts = np.unique(keys, return_index=True, return_counts=True)
                places = first[where]
                word = found.words.words
                out.append(([names[i] for i in langs[places].tolist()],
                            [b" ".join([word[w] for w in row]) for row in
                             np.stack([ids[places + i] for i in range(n)], 1).tolist()],
                            [n] * len(places), counts.tolist()))
            for lang, phrase, n, count in out:
                for k in range(0, len(lang), PACK):
                    s = slice(k, k + PACK)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lang[s], pa.string()), pa.array(phrase[s], pa.binary()).cast(pa.string()),
                         pa.array(n[s], pa.int32()), pa.array(count[s], pa.int64())], ["lang", "phrase", "words", "f"])

    return run


def frequent_phrases(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text",
                     least: int = LEAST) -> DataFrame:
    """lang, phrase (words joined by a space), words (1 to 3), f: the phrases
    that occur ``least`` times in their language, with the exact count; and a
    row of each language that has words with phrase null, words 0 and all its
    word occurrences.

    * A-Z are lower-cased; pieces end at ``.,;:!?`` and line breaks, words at
      spaces and tabs; phrases stay within a piece; overlaps count
    * null lang: ``und``; null text: empty; repeated rows count again; empty
      table: no rows
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = narrow(docs, lang=lang_col, text=text_col)
    bitmap, bits = _filter(survivors(rows, least))
    counted = rows.mapInArrow(_counted(spark.sparkContext.broadcast(bitmap), bits),
                              "lang string, phrase string, words int, f long")
    return materialise(counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
                       .where((F.col("f") >= least) | ((F.col("words") == 0) & (F.col("f") > 0))), "phrases")


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                 inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the ``top``
    phrases of 2 to 3 words by score, a (both descending) and phrase.

    a, l and r are the counts of the phrase and of the two parts of the cut
    with the lowest ``floor(1000000 a a / (l r))`` (ties: the earliest), n the
    language's words.  A phrase with ``inside`` per cent of its occurrences or
    more within one longer phrase is dropped.  Parts of a frequent phrase are
    frequent, so all counts come from ``frequent_phrases``; products are exact
    in 38 digits."""
    found = frequent_phrases(docs, lang_col=lang_col, text_col=text_col, least=least)
    word = F.split("phrase", " ")
    cand = found.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), word.alias("w"))
    longer = (cand.where(f"words = {WORDS}")
              .select("lang", F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " ")))
                      .alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("_in")))
    kept = (cand.join(longer, ["lang", "phrase"], "left")
            .where(F.col("_in").isNull() | (100 * F.col("_in") < inside * F.col("a"))).drop("_in"))
    cuts = (kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"),
                    F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("right")))
    f = found.where(f"words BETWEEN 1 AND {WORDS - 1}")
    cuts = (cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    big = {c: F.col(c).cast("decimal(18,0)") for c in "alr"}
    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * (_a * _a)) div (_l * _r)")
    scored = (cuts.withColumns({f"_{c}": v for c, v in big.items()})
              .select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("c"))
              .select("lang", "phrase", "a", "c.l", "c.r", F.col("c.score").alias("score")))
    best = top_n_per_group(scored, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top,
                           rank_col="rank")
    sizes = found.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                           "n", "score")
