"""Jaccard join on word n-grams by prefix trees.

1. Every whole text becomes its set of n-gram hashes; documents with one set
   are one class.  Tasks count in how many classes each n-gram occurs: packed
   arrays of hashes are shuffled by hash range and sorted there.
2. N-grams are ordered globally by that frequency (saturated, see ``RARE``).
   A class whose first ``n - ceil(t n) + 1`` n-grams all occur nowhere else
   can have no link and leaves; most documents do.
3. The remaining classes meet through the n-grams of that prefix.  Classes
   that are connected by shared prefix n-grams go to one task, which stores
   their ordered sets in a prefix tree and probes it with each set: overlaps
   of a shared path are counted once, and a subtree is left as soon as the
   overlap plus what remains cannot reach the threshold.  Large families are
   dealt to tasks as pairs of blocks.

Hashes have 64 bits.  No cap, sample or approximation decides about a link.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .common import fresh, materialise, narrow, only_cache, short_batches, shuffle_partitions

#: Words of an n-gram and the threshold in per cent.
WORDS, PERCENT = 4, 85
#: Frequencies are counted exactly up to here; more frequent n-grams tie.  A
#: task that sees one in so many classes needs no one else to know its rank,
#: so the postings of a hot n-gram never meet in one task.
RARE = 32
#: Hashes of a packed batch, of a hash range, and of a block of sets.
BATCH_HASHES, RANGE_HASHES, BLOCK_HASHES = 1_000_000, 1_000_000, 1_500_000
MEMO_WORDS = 400_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, memo: dict, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams; of a shorter text its whole
    word sequence is the only one; no words: empty."""
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    s = h[:len(h) - k + 1].copy()
    for i in range(1, k):
        s = _mix(s) + h[i:len(h) - k + 1 + i]
    return np.unique(_mix(s + np.uint64(k)))


def _class_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _fresh(memo: dict) -> dict:
    if len(memo) > MEMO_WORDS:
        memo.clear()
    return memo


def document_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  n: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, cls: the 64-bit key of the set (null if empty)."""
    def run(batches):
        only_cache()
        memo = _WordHashes()
        for batch in batches:
            sizes, keys = [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), _fresh(memo), n)
                sizes.append(len(s))
                keys.append(np.uint64(_class_key(s)).astype(np.int64).item() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())],
                ["doc_id", "n_shingles", "cls"])

    short_batches(docs.sparkSession)
    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, cls long")


# --- frequencies ----------------------------------------------------------

def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of the 64-bit space; monotone."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


_PACK = "g long, hashes binary, dfs binary, at binary, keys binary, sizes binary, hot binary"


def _packed(g: int, hashes, owner, keys, sizes, dfs=None, hot=None) -> tuple:
    """A row of postings: hash, and place of its class in the row's table."""
    used, at = np.unique(owner, return_inverse=True)
    kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
    return (g, hashes.tobytes(), b"" if dfs is None else dfs.astype(np.uint8).tobytes(),
            at.astype(kind).tobytes(), keys[used].tobytes(), sizes[used].astype(np.uint32).tobytes(),
            b"" if hot is None else hot.tobytes())


def _unpacked(pdf: pd.DataFrame):
    """(hashes, dfs, class keys, class sizes) of all rows."""
    parts = []
    for r in pdf.itertuples(index=False):
        hashes = np.frombuffer(r.hashes, np.uint64)
        keys, sizes = np.frombuffer(r.keys, np.uint64), np.frombuffer(r.sizes, np.uint32)
        at = np.frombuffer(r.at, np.uint16 if len(keys) <= 1 << 16 else np.uint32)
        dfs = np.frombuffer(r.dfs, np.uint8) if r.dfs else np.zeros(len(hashes), np.uint8)
        parts.append((hashes, dfs, keys[at], sizes[at]))
    return tuple(map(np.concatenate, zip(*parts)))


def _ranges(sorted_parts: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(part, slice) of runs of an ascending array."""
    if len(sorted_parts):
        edges = [0, *(np.flatnonzero(np.diff(sorted_parts)) + 1).tolist(), len(sorted_parts)]
        for a, b in zip(edges, edges[1:]):
            yield int(sorted_parts[a]), slice(a, b)


def _postings(docs: DataFrame, ranges: int, n: int) -> DataFrame:
    """Packed postings by hash range.  Documents of one class that meet in a
    batch count once.  N-grams of at least RARE classes of the batch go as a
    mere mark to their range, and their postings to further groups."""
    def run(batches):
        only_cache()
        memo = _WordHashes()
        held: dict[int, np.ndarray] = {}
        total = flushes = 0

        def flush():
            keys = np.fromiter(held, np.uint64, len(held))
            sizes = np.fromiter(map(len, held.values()), np.uint32, len(held))
            hashes, owner = np.concatenate(list(held.values())), np.repeat(np.arange(len(held)), sizes)
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            values, counts = np.unique(hashes, return_counts=True)
            often = np.repeat(counts >= RARE, counts)
            hot = values[counts >= RARE]
            if len(hot):  # dealt by class, as it is classes that gather them
                h, o = hashes[often], owner[often]
                part = _part(keys[o], ranges)
                by = np.argsort(part, kind="stable")
                for g, s in _ranges(part[by]):
                    yield _packed(ranges + g, h[by][s], o[by][s], keys, sizes)
            hashes, owner = hashes[~often], owner[~often]
            marks = {g: hot[s] for g, s in _ranges(_part(hot, ranges))}
            for g, s in _ranges(_part(hashes, ranges)):
                yield _packed(g, hashes[s], owner[s], keys, sizes, hot=marks.pop(g, None))
            for g, mark in marks.items():
                yield _packed(g, hashes[:0], owner[:0], keys, sizes, hot=mark)

        def out():
            rows = []
            for row in flush():
                rows.append(row)
                if len(rows) == 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        for batch in batches:
            for text in batch.column("text"):
                s = shingles(text.as_py(), _fresh(memo), n)
                if not len(s):
                    continue
                key = _class_key(s)
                if key not in held:
                    held[key] = s
                    total += len(s)
                if total >= BATCH_HASHES:
                    yield from out()
                    held.clear()
                    total = 0
        if held:
            yield from out()

    return docs.mapInArrow(run, _PACK)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["g", "hashes", "dfs", "at", "keys", "sizes", "hot"]
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()),
                                       *(pa.array(c, pa.binary()) for c in columns[1:])], names)


def _count(ranges: int):
    """Group function: postings of one hash range -> those of n-grams of at
    least two classes, with the saturated frequency, by class range."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        only_cache()
        hashes, _, keys, sizes = _unpacked(pdf)
        if pdf.g.iloc[0] >= ranges:
            dfs = np.full(len(hashes), RARE)
        else:
            order = np.lexsort((keys, hashes))
            hashes, keys, sizes = hashes[order], keys[order], sizes[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1])
            hashes, keys, sizes = hashes[new], keys[new], sizes[new]
            values, counts = np.unique(hashes, return_counts=True)
            marked = np.unique(np.concatenate([np.frombuffer(h, np.uint64) for h in pdf.hot]))
            df = np.where(np.isin(values, marked), RARE, np.minimum(counts, RARE))
            dfs = np.repeat(df, counts)
            keep = dfs >= 2
            hashes, keys, sizes, dfs = hashes[keep], keys[keep], sizes[keep], dfs[keep]
        part = _part(keys, ranges)
        by = np.argsort(part, kind="stable")
        table, first, owner = np.unique(keys, return_index=True, return_inverse=True)
        table_sizes = sizes[first] if len(table) else np.zeros(0, np.uint32)
        rows = [_packed(g, hashes[by][s], owner[by][s], table, table_sizes, dfs=dfs[by][s])
                for g, s in _ranges(part[by])]
        return pd.DataFrame(rows, columns=["g", "hashes", "dfs", "at", "keys", "sizes", "hot"])
    return run


def _prefix_size(n, percent: int):
    """How many first n-grams of a set one of any linked set must be among."""
    return n - (-(-percent * n // 100)) + 1


def _survivors(percent: int):
    """Group function: shared postings of a range of classes -> classes with a
    shared n-gram in their prefix: cls, n, tokens and dfs (shared n-grams in
    global order, rarest first), prefix (how many of them lie in it)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, dfs, keys, sizes = _unpacked(pdf)
        order = np.lexsort((hashes, dfs, keys))
        hashes, dfs, keys, sizes = hashes[order], dfs[order], keys[order], sizes[order]
        new = np.ones(len(hashes), bool)  # a class of several batches sent its hot n-grams twice
        new[1:] = (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1])
        hashes, dfs, keys, sizes = hashes[new], dfs[new], keys[new], sizes[new]
        values, first, counts = np.unique(keys, return_index=True, return_counts=True)
        n = sizes[first].astype(np.int64)
        prefix = _prefix_size(n, percent) - (n - counts)
        out = []
        for i in np.flatnonzero(prefix > 0):
            s = slice(first[i], first[i] + counts[i])
            out.append((values[i].astype(np.int64).item(), int(n[i]), hashes[s].tobytes(),
                        dfs[s].tobytes(), int(min(prefix[i], counts[i]))))
        return pd.DataFrame(out, columns=["cls", "n", "tokens", "dfs", "prefix"])
    return run


def _linkable(docs: DataFrame, total: int, n: int, percent: int) -> DataFrame:
    """Classes that may have links, see ``_survivors``."""
    spark = docs.sparkSession
    ranges = max(shuffle_partitions(spark), -(-total // RANGE_HASHES))
    shared = (_postings(docs, ranges, n).repartition(ranges, "g").groupBy("g")
              .applyInPandas(_count(ranges), _PACK))
    return materialise(
        shared.groupBy("g").applyInPandas(
            _survivors(percent), "cls long, n long, tokens binary, dfs binary, prefix long"), "ngram-linkable")


# --- the prefix tree ------------------------------------------------------

class _Node:
    """A run of tokens, what lies below it, and sets that end here."""

    __slots__ = ("tokens", "below", "ends", "least", "rest", "family")

    def __init__(self, tokens: tuple, ends: list, least: int, rest: int, family: int | None):
        self.tokens, self.below, self.ends = tokens, {}, ends
        self.least = least    # smallest set size in the subtree
        self.rest = rest      # most tokens that follow this run in the subtree
        self.family = family  # a set of it, while all its sets are of one family


class PrefixTree:
    """Sets of ascending ranks with sizes; links are 100 |x ∩ y| >= percent
    |x ∪ y|, where ``sizes`` also count members that no other set has.

    With ``forest`` a probe skips subtrees of its own family, so every family
    is found connected, by at most one link less than it has sets.  Without
    it, all links are found."""

    def __init__(self, percent: int = PERCENT, forest: bool = True):
        self._percent, self._forest = percent, forest
        self._root = _Node((), [], 1 << 62, 0, None)
        self._sizes: list[int] = []
        self._parent: list[int] = []

    def _find(self, i: int) -> int:
        parent = self._parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def _family(self, node: _Node) -> int | None:
        """The family of all sets below, if it is one; found again from the
        children after families have been joined."""
        if node.family is None:
            found = {self._find(i) for i in node.ends}
            for child in node.below.values():
                if child.family is None or len(found) > 1:
                    return None
                found.add(self._find(child.family))
            if len(found) != 1:
                return None
            node.family = found.pop()
        return self._find(node.family)

    def register(self, size: int) -> int:
        self._sizes.append(size)
        self._parent.append(len(self._parent))
        return len(self._parent) - 1

    def probe(self, me: int, ranks: list[int]) -> list[tuple[int, int]]:
        """Links (other, overlap) of set ``me``; joins the families."""
        n, percent, forest = self._sizes[me], self._percent, self._forest
        own, links = set(ranks), []
        stack = [(child, 0) for child in self._root.below.values()]
        while stack:
            node, overlap = stack.pop()
            if forest and self._family(node) == self._find(me):
                continue
            # a link needs (100 + percent) * overlap >= percent * (n + size)
            need = percent * (n + max(node.least, -(-percent * n // 100)))
            tokens, reach = node.tokens, True
            for i in range(0, len(tokens), 32):
                part = tokens[i:i + 32]
                overlap += len(own.intersection(part))
                follow = len(ranks) - bisect_right(ranks, part[-1])
                rest = node.rest + len(tokens) - i - len(part)
                if (100 + percent) * (overlap + min(follow, rest)) < need:
                    reach = False
                    break
            if not reach:
                continue
            for other in node.ends:
                size = self._sizes[other]
                if (100 + percent) * overlap >= percent * (n + size) and other != me:
                    if not forest or self._find(other) != self._find(me):
                        links.append((other, overlap))
                        self._parent[self._find(other)] = self._find(me)
            if node.below:
                near = [c for t, c in node.below.items() if t in own]
                stack.extend((c, overlap) for t, c in node.below.items() if t not in own)
                stack.extend((c, overlap) for c in near)  # likely links first
        return links

    def insert(self, me: int, ranks: list[int]) -> None:
        size, node, at = self._sizes[me], self._root, 0
        while True:
            if at == len(ranks):
                node.ends.append(me)
                return
            child = node.below.get(ranks[at])
            if child is None:
                node.below[ranks[at]] = _Node(tuple(ranks[at:]), [me], size, 0, me)
                return
            run, k = child.tokens, 1
            most = min(len(run), len(ranks) - at)
            while k < most and run[k] == ranks[at + k]:
                k += 1
            if k < len(run):  # split the run
                lower = _Node(run[k:], child.ends, child.least, child.rest, child.family)
                lower.below = child.below
                child.tokens, child.ends, child.below = run[:k], [], {run[k]: lower}
                child.rest += len(lower.tokens)
            at += k
            child.least = min(child.least, size)
            child.rest = max(child.rest, len(ranks) - at)
            if child.family is not None and self._find(child.family) != self._find(me):
                child.family = None
            node = child


def _links(pdf: pd.DataFrame, percent: int, forest: bool) -> pd.DataFrame:
    """Links among the sets of one task.  Rows: family, cls, n, tokens, dfs,
    side (0: tree, 1: probes only, 2: both)."""
    out = []
    for _, family in pdf.groupby("family", sort=False):
        family = family.sort_values(["side", "n", "cls"])
        tokens = [np.frombuffer(t, np.uint64) for t in family.tokens]
        dfs = [np.frombuffer(d, np.uint8) for d in family.dfs]
        # ranks: most frequent first, so that similar sets share long paths
        all_tokens, at = np.unique(np.concatenate(tokens), return_index=True)
        df = np.concatenate(dfs)[at]
        rank = np.empty(len(all_tokens), np.int64)
        rank[np.lexsort((all_tokens, -df.astype(np.int64)))] = np.arange(len(all_tokens))
        tree = PrefixTree(percent, forest)
        keys = family.cls.tolist()
        for i, (n, side, t) in enumerate(zip(family.n.tolist(), family.side.tolist(), tokens)):
            me = tree.register(n)
            ranks = np.sort(rank[np.searchsorted(all_tokens, t)]).tolist()
            # tree sets probe for a forest, too: a probe of the other block then
            # meets joined families instead of single sets
            if side != 0 or forest:
                out.extend((keys[i], keys[j], o, n, tree._sizes[j]) for j, o in tree.probe(me, ranks))
            if side != 1:
                tree.insert(me, ranks)
    return pd.DataFrame(out, columns=["a", "b", "overlap", "n_a", "n_b"])


def class_links(docs: DataFrame, sets: DataFrame, *, n: int = WORDS, percent: int = PERCENT,
                forest: bool = True) -> DataFrame:
    """Links a, b, overlap, n_a, n_b between classes.  ``docs``: a column
    text; ``sets``: the written result of ``document_sets`` of the same rows.
    With ``forest`` enough links to connect every component, else all."""
    spark = docs.sparkSession
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    sets_ = _linkable(docs.select("text"), total, n, percent)

    def prefixes(batches):
        for pdf in batches:
            tokens = [np.frombuffer(t, np.int64)[:k] for t, k in zip(pdf.tokens, pdf.prefix)]
            yield pd.DataFrame({"token": np.concatenate([np.zeros(0, np.int64), *tokens]),
                                "cls": np.repeat(pdf.cls.to_numpy(), [len(t) for t in tokens])})

    postings = materialise(sets_.select("cls", "tokens", "prefix")
                           .mapInPandas(prefixes, "token long, cls long"), "ngram-prefixes")
    centres = materialise(postings.groupBy("token").agg(F.min("cls").alias("centre"), F.count(F.lit(1)).alias("k"))
                          .where("k > 1").select("token", "centre"), "ngram-centres")
    stars = postings.join(centres, "token").where("cls != centre").select("cls", "centre").distinct()
    families = components(stars)
    member = families.select(F.col("a").alias("cls"), F.col("b").alias("family")).union(
        families.select(F.col("b").alias("cls"), F.col("b").alias("family")).distinct())
    members = materialise(sets_.drop("prefix").join(member, "cls"), "ngram-members")
    weight = F.octet_length("dfs").cast("long")
    sizes = members.groupBy("family").agg(F.sum(weight).alias("_w"))
    sizes = sizes.withColumn("_blocks", F.ceil(F.col("_w") / BLOCK_HASHES).cast("int"))
    sizes = materialise(sizes, "ngram-families")
    small_tasks = max(shuffle_partitions(spark), -(-(sizes.agg(F.sum("_w")).first()[0] or 0) // BLOCK_HASHES))
    dealt = members.join(sizes, "family").withColumn("_b", F.pmod(F.xxhash64("cls"), F.col("_blocks")).cast("int"))
    # a family of one block: whole into one of many tasks.  Of more: every
    # pair of blocks i <= j is a task, the tree from i, the probes from j
    pairs = dealt.withColumn("_o", F.explode(F.expr("sequence(0, _blocks - 1)")))
    pairs = pairs.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o"))
    tasks = pairs.select(
        "family", "cls", "n", "tokens", "dfs",
        F.when(F.col("_i") == F.col("_j"), F.lit(2)).when(F.col("_b") == F.col("_i"), F.lit(0))
        .otherwise(F.lit(1)).alias("side"),
        F.when(F.col("_blocks") == 1, F.struct(
            F.lit(-1).cast("long").alias("f"), F.pmod(F.xxhash64("family"), F.lit(small_tasks)).cast("int").alias("i"),
            F.lit(0).alias("j")))
        .otherwise(F.struct(F.col("family").alias("f"), F.col("_i").alias("i"), F.col("_j").alias("j"))).alias("task"))
    return materialise(tasks.groupBy("task").applyInPandas(
        lambda pdf: _links(pdf, percent, forest), "a long, b long, overlap long, n_a long, n_b long"), "ngram-links")


def similar_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
                  percent: int = PERCENT) -> DataFrame:
    """All links between classes of equal sets: id_a, id_b (the classes'
    smallest ids, id_a < id_b), jaccard.  Use ``similar_groups`` where the
    number of links within a family may be too large to list."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    sets = materialise(document_sets(rows, n=n), "ngram-sets")
    links = class_links(rows, sets, n=n, percent=percent, forest=False)
    first = materialise(sets.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("id")), "ngram-first")
    a, b = first.select(F.col("cls").alias("a"), F.col("id").alias("x")), first.select(
        F.col("cls").alias("b"), F.col("id").alias("y"))
    return links.join(a, "a").join(b, "b").select(
        F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"),
        (F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap"))).alias("jaccard"))


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
                   percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    * two documents link when 100 |x ∩ y| >= percent |x ∪ y| of their sets of
      word n-grams; the component is the smallest id reachable over links
    * null, empty or blank text: no n-grams, its own component
    * repeated rows and equal texts share a component; null ids come out with
      the component of their text, or null on their own
    * empty table: no rows; further columns are not carried
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    sets = materialise(document_sets(rows, n=n), "ngram-sets")
    links = class_links(rows, sets, n=n, percent=percent)
    labels = components(links.select("a", "b"))
    label = labels.select(F.col("a").alias("cls"), F.col("b").alias("label")).union(
        labels.select(F.col("b").alias("cls"), F.col("b").alias("label")).distinct())
    first = (sets.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"))
             .join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls")))
    first = materialise(first, "ngram-classes")
    smallest = materialise(first.groupBy("label").agg(F.min("first").alias("component_id")), "ngram-smallest")
    named = materialise(first.join(smallest, "label").select("cls", "component_id"), "ngram-named")
    return sets.join(named, "cls", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
                 percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, all columns kept: the one
    with the smallest id (of one id that with the smallest hash of its text).

    Documents are told apart by id and text, so rows that share an id are
    judged each by its own text; rows that repeat with id and text are one
    document and stay or go together.  Rows without an id or n-grams stay."""
    key = fresh(docs, "key")
    keyed = docs.withColumn(key, F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"),
                                          F.xxhash64(F.col(f"`{text_col}`")).alias("text")))
    groups = similar_groups(keyed, id_col=key, text_col=text_col, n=n, percent=percent)
    out = materialise(groups.where("component_id != doc_id AND NOT doc_id.none").select(F.col("doc_id").alias(key)).distinct(),
                      "ngram-dropped")
    return keyed.join(out, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
