"""TF-IDF cosine similarity between two sides.

Weights follow the common smooth-idf definition: raw term count x
(ln((1 + n) / (1 + df)) + 1), L2-normalised per document, where n and df
count every document of both sides (duplicates included).

Pairs come from an inverted-index equi-join on the token — only documents
that share a token ever meet, no cross join.  Pairs are
found through an exact bound-based index (tokens ordered rare-first; a token
is indexed while the rest of the vector could still reach the threshold,
bounded with each token's largest weight on the other side and with the rest's
L2 norm), so frequent tokens do not pair up every document that contains them.
A pair whose indexed tokens and what can follow them stay below the threshold
leaves; every other found pair is scored over its complete vectors (all tokens
of the whole texts).

Hot tokens: values per token (document frequency, largest weight) reach the
postings of a token above ``hot_bound`` by broadcast, whose size that bound
limits, so those postings are never shuffled by the token; where A meets B on
the token, both sides are split over salts, by a factor that follows the
document frequency each posting carries.  Partial sums per (a, b) pair are
combined map-side.

Copies: documents of a side with one text have one vector, so texts are compared
and not documents (``text_pairs``).  Where one side is small (``SMALL_POSTINGS``),
its weights go to the vectors of the other by broadcast instead of the index.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import tokens
from ..functions.ordered import top_n_per_group
from ..session import materialise as materialise_table
from ..session import materialise_counted


def term_counts(docs: DataFrame, id_col: str = "id", text_col: str = "text",
                side: str | None = None) -> DataFrame:
    """(side, id, token, tf) — raw count of each token in a document."""
    toks = docs.select(F.lit(side).alias("side"), F.col(id_col).alias("id"),
                       F.explode(tokens(text_col)).alias("token"))
    return toks.groupBy("side", "id", "token").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(a: DataFrame, b: DataFrame, id_col: str = "id", text_col: str = "text",
          materialise: bool = True) -> DataFrame:
    """See ``_weights``; written once with ``materialise``."""
    out = _weights(a, b, id_col, text_col, materialise)
    return materialise_table(out, "tfidf") if materialise else out


def _weights(a: DataFrame, b: DataFrame, id_col: str, text_col: str, materialise: bool = True) -> DataFrame:
    """Normalised weights (side, id, token, w, df) over the corpus A ∪ B.

    A document with no token has no row (its vector is zero).

    Tokenising whole texts is the expensive step, and its result feeds the
    document frequencies, the weights and the norms.  The term counts and
    the final weights are therefore written once as tables in the session's
    shared checkpoint folder (``materialise``): every later use reads them
    instead of re-tokenising, and a lost executor recomputes nothing
    upstream of them."""
    tc = term_counts(a, id_col, text_col, "A").unionByName(term_counts(b, id_col, text_col, "B"))
    if materialise:
        tc, postings = materialise_counted(tc, "term_counts")
    else:
        postings = tc.count()
    n_docs = (a.select(F.lit(1).alias("x")).unionByName(b.select(F.lit(1).alias("x")))
              .agg(F.count(F.lit(1)).cast("double").alias("_n")))
    dfreq = tc.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("posts", F.col("df"))
    if materialise:
        dfreq = materialise_table(dfreq, "token_df")
    return _weigh(tc, dfreq, n_docs, postings)


def _weigh(tc: DataFrame, dfreq: DataFrame, n_docs: DataFrame, postings: int) -> DataFrame:
    """Weights of the term counts, given (token, df, posts): the documents with
    the token, and its postings (fewer, where a posting stands for copies),
    which the result has as ``df``."""
    bound = hot_bound(postings)
    hot = F.broadcast(dfreq.where(F.col("posts") > bound))
    with_df = (tc.join(hot, "token")
               .unionByName(tc.join(hot.select("token"), "token", "left_anti").join(dfreq, "token")))
    w = with_df.crossJoin(F.broadcast(n_docs)).withColumn("w", F.col("tf") * _idf(F.col("_n"), F.col("df")))
    # The L2 norm is a window over the document: one exchange by document.
    # (An aggregate joined back would shuffle twice, and its map-side partial
    # sums barely shrink: the rows arrive partitioned by token, so every map
    # task holds a little of every document.)
    doc = Window.partitionBy("side", "id")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(doc))
    return w.select("side", "id", "token", (F.col("w") / norm).alias("w"), F.col("posts").alias("df"))


def _idf(n, df) -> F.Column:
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + 1.0


#: A token is hot above so many postings, and above a share of all postings
#: that leaves at most HOT_TOKENS hot ones: the size bound of their broadcast.
HOT_POSTINGS, HOT_TOKENS = 200_000, 10_000


def hot_bound(postings: int) -> int:
    """Postings from which on a token is hot, given the number of all."""
    return max(HOT_POSTINGS, postings // HOT_TOKENS)


def _token_join(a_post: DataFrame, b_post: DataFrame, postings_per_task: int) -> DataFrame:
    """Equi-join A and B postings (id, token, w, df, further columns) on the
    token; both sides' columns get 1 and 2 at their end.  With
    ``k = ceil(df / per_task)`` from the posting's own df, each side is cut
    into k shares by document and sent to the k shares of the other side, so a
    hot token's pairs spread over k x k tasks."""
    k = F.greatest(F.lit(1), F.ceil(F.col("df") / F.lit(postings_per_task))).cast("int")
    share = F.pmod(F.xxhash64(F.col("id")), k).cast("int")
    others = F.explode(F.sequence(F.lit(0), k - 1))

    def side(post: DataFrame, mine: str, theirs: str, tag: str) -> DataFrame:
        rest = [F.col(c).alias(f"{c}{tag}") for c in post.columns if c not in ("id", "token", "df")]
        return (post.withColumn(mine, share).withColumn(theirs, others)
                .select(F.col("id").alias(f"id_{tag}"), "token", *rest, "_sa", "_sb"))

    return (side(a_post, "_sa", "_sb", "1").join(side(b_post, "_sb", "_sa", "2"), ["token", "_sa", "_sb"])
            .drop("_sa", "_sb"))


def candidate_index(wt: DataFrame, threshold: float, eps: float = 1e-9, postings: int | None = None) -> DataFrame:
    """Bound-based candidate index for ``score >= threshold`` (exact): adds
    ``_pref`` (the token is indexed), ``_mw`` (its largest weight on the other
    side), and what can follow the token: ``_rs`` and ``_rn``, the two bounds
    below over the tokens after it.  Every token of every whole text keeps its
    weight; the index only decides which shared tokens are enough to *find* a
    pair.

    Tokens of every vector are ordered rare-first (document frequency
    ascending, then token); tokens that the other side lacks count as 0.  What
    the part of a vector from token i on can add to any dot product has two
    bounds: ``sum_j>=i w_j * maxw_j(other side)``, and, the other vector's norm
    being 1, the norm ``sqrt(sum_j>=i w_j ** 2)`` (Cauchy-Schwarz), which is
    the smaller one for long texts of even weights.  A token is indexed while
    both are >= threshold.  If two vectors share no indexed token, all shared
    tokens lie in the tail of the one whose prefix ends first, whose bound is
    < threshold — so no pair reaching the threshold is lost.  Tokens absent
    from the other side are never indexed; frequent low-weight tokens fall
    into the tail."""
    # both sides' largest weight per token in one aggregate
    mx = materialise_table(wt.groupBy("token", "df").agg(
        F.max(F.when(F.col("side") == "A", F.col("w"))).alias("_ma"),
        F.max(F.when(F.col("side") == "B", F.col("w"))).alias("_mb")), "token_max")
    bound = hot_bound(wt.count() if postings is None else postings)
    is_hot = F.col("df") > bound
    x = (wt.where(is_hot).join(F.broadcast(mx.where(is_hot).drop("df")), "token")
         .unionByName(wt.where(~is_hot).join(mx.where(~is_hot).drop("df"), "token"))
         .withColumn("_mw", F.coalesce(F.when(F.col("side") == "A", F.col("_mb")).otherwise(F.col("_ma")),
                                       F.lit(0.0)))
         .drop("_ma", "_mb"))
    order = Window.partitionBy("side", "id").orderBy(F.col("df").desc(), F.col("token").desc())
    here = order.rowsBetween(Window.unboundedPreceding, 0)
    after = order.rowsBetween(Window.unboundedPreceding, -1)  # the order is reversed: less rare tokens come first
    sums = F.col("w") * F.least(F.lit(1.0), F.col("_mw"))
    squares = F.when(F.col("_mw") > 0, F.col("w") * F.col("w")).otherwise(F.lit(0.0))
    x = x.withColumns({"_s": F.sum(sums).over(here), "_q": F.sum(squares).over(here),
                       "_rs": F.coalesce(F.sum(sums).over(after), F.lit(0.0)),
                       "_rn": F.sqrt(F.coalesce(F.sum(squares).over(after), F.lit(0.0)))})
    limit = F.lit(threshold - eps)
    out = x.withColumn("_pref", (F.col("_s") >= limit) & (F.sqrt("_q") >= limit) & (F.col("_mw") > 0))
    return materialise_table(out.drop("_s", "_q"), "candidate_index")


def candidate_pairs(ix: DataFrame, threshold: float, postings_per_task: int = 200_000,
                    eps: float = 1e-9) -> DataFrame:
    """(id_1, id_2, s): the pairs of the index that may reach the threshold,
    with the dot product over their indexed tokens.

    The tokens after a shared indexed token add at most the smaller of both
    sides' remaining sums, and at most the product of both sides' remaining
    norms.  The last shared indexed token has the smallest of these bounds, so
    their minimum over the join's rows, added to ``s``, decides; pairs that
    merely share a rare token leave here, before any tail is read."""
    post = ix.where("_pref").select("side", "id", "token", "w", "df", F.col("_rs").alias("rs"), F.col("_rn").alias("rn"))
    a, b = (post.where(F.col("side") == side).drop("side") for side in "AB")
    rest = F.least(F.col("rs1"), F.col("rs2"), F.col("rn1") * F.col("rn2"))
    return (_token_join(a, b, postings_per_task)
            .groupBy("id_1", "id_2").agg(F.sum(F.col("w1") * F.col("w2")).alias("s"), F.min(rest).alias("_rest"))
            .where(F.col("s") + F.col("_rest") >= F.lit(threshold - eps)).drop("_rest"))


#: A side with at most so many postings is sent whole to the other's vectors.
SMALL_POSTINGS = 200_000

#: Postings of the larger side per task, and tokens that the broadcast of
#: document frequencies has at most (besides the small side's).
TASK_POSTINGS, KNOWN_TOKENS = 1_000_000, 1_000_000

#: Members of a text per row when pairs of texts become pairs of documents, and
#: from how many copies on these rows are dealt out anew.
CHUNK, MANY = 512, 64


@dataclass(frozen=True)
class TextPairs:
    """Pairs of texts: ``pairs`` (id_1, id_2, score) between the smallest ids of
    their documents, ``chunks`` (side, rep, ids): all documents of each text
    (None where every document has a text of its own), and ``documents``
    (side, id)."""

    pairs: DataFrame
    chunks: DataFrame | None
    copies: int
    documents: DataFrame

    def _side(self, side: str, rep: str, ids: str) -> DataFrame:
        return self.chunks.where(F.col("side") == side).select(F.col("rep").alias(rep), F.col("ids").alias(ids))

    def members(self, side: str, reps: DataFrame) -> DataFrame:
        """``reps`` (id, further columns) with a row for every document."""
        if self.chunks is None:
            return reps
        rest = [c for c in reps.columns if c != "id"]
        return reps.join(self._side(side, "id", "_ids"), "id").select(F.explode("_ids").alias("id"), *rest)

    def without(self, side: str, reps: DataFrame) -> TextPairs:
        """The pairs and documents left without the texts ``reps`` (id) of a side."""
        gone = reps.select(F.lit(side).alias("side"), F.col("id").alias("rep"))
        other = f"id_{'AB'.index(side) + 1}"
        pairs = self.pairs.join(reps.select(F.col("id").alias(other)), other, "left_anti").select(*self.pairs.columns)
        if self.chunks is None:
            left = self.documents.join(gone.withColumnRenamed("rep", "id"), ["side", "id"], "left_anti")
            return replace(self, pairs=pairs, documents=left)
        left = self.chunks.join(gone, ["side", "rep"], "left_anti")
        return replace(self, pairs=pairs, chunks=left, documents=left.select("side", F.explode("ids").alias("id")))

    def membership(self) -> DataFrame:
        """(side, id, class_id): every document, with or without a pair, and
        the smallest id of its side that has its text."""
        if self.chunks is None:
            return self.documents.select("side", "id", F.col("id").alias("class_id"))
        return self.chunks.select("side", F.explode("ids").alias("id"), F.col("rep").alias("class_id"))

    def expand(self) -> DataFrame:
        """(id_1, id_2, score) of all documents.  The shuffles hold rows of
        up to CHUNK x CHUNK pairs; single pairs appear only in the output."""
        if self.chunks is None:
            return self.pairs
        wide = self.pairs.join(self._side("A", "id_1", "_a"), "id_1").join(self._side("B", "id_2", "_b"), "id_2")
        if self.copies > MANY:
            n = int(self.pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            wide = wide.repartition(n, F.col("id_1"), F.col("id_2"), F.col("_a")[0], F.col("_b")[0])
        return (wide.select(F.explode("_a").alias("id_1"), "_b", "score")
                .select("id_1", F.explode("_b").alias("id_2"), "score"))


def text_pairs(a: DataFrame, b: DataFrame, threshold: float, id_col: str = "id", text_col: str = "text",
               postings_per_task: int = 200_000) -> TextPairs:
    """T3/J11/C13 between texts: the pairs with ``score > threshold`` (above 0:
    every pair that merely shares a token would be a quadratic result), as in
    ``cosine_pairs``.

    The documents of a side with the same text have the same vector, so one of
    them stands for all, with their number in the document frequencies."""
    if not threshold > 0:
        raise ValueError("threshold must be above 0")
    rows = reduce(DataFrame.unionByName, [
        d.select(F.lit(side).alias("side"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        for side, d in (("A", a), ("B", b))])
    # rows of one id are one document
    seen = Observation("documents")
    ids = materialise_table(
        rows.groupBy("side", "id").agg(
            F.array_join(F.array_sort(F.collect_list(F.coalesce(F.md5("text"), F.lit("")))), " ").alias("key"),
            F.count(F.lit(1)).alias("_rows"))
        .observe(seen, F.count(F.lit(1)).alias("ids"), F.sum("_rows").alias("rows")).drop("_rows"), "texts")
    n_ids, n_rows = int(seen.get["ids"]), int(seen.get["rows"] or 0)
    seen = Observation("distinct texts")
    reps = materialise_table(
        ids.groupBy("side", "key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"))
        .observe(seen, F.count(F.lit(1)).alias("texts"), F.max("m").alias("copies")), "distinct_texts")
    n_texts, copies = int(seen.get["texts"]), int(seen.get["copies"] or 0)
    chunks = None
    if n_texts < n_ids:
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / F.lit(CHUNK)))
        chunks = materialise_table(
            ids.join(reps.withColumnRenamed("id", "rep"), ["side", "key"]).groupBy("side", "rep", part.alias("_part"))
            .agg(F.collect_list("id").alias("ids")).drop("_part"), "text_members")
    # by document from the join on: the counts and vectors need no exchange
    vectors = materialise_table(
        rows.hint("merge").join(reps.drop("key"), ["side", "id"])
        .select("side", "id", "m", F.explode(tokens("text")).alias("token"))
        .groupBy("side", "id", "m", "token").agg(F.count(F.lit(1)).alias("tf"))
        .groupBy("side", "id", "m").agg(F.collect_list(F.struct("token", "tf")).alias("terms")), "term_vectors")
    posts = vectors.select("side", "id", "m", F.explode("terms").alias("_t")).select("side", "id", "m", "_t.*")
    on_a = F.col("side") == "A"
    dfreq = materialise_table(posts.groupBy("token").agg(
        F.sum("m").alias("df"), F.count(F.lit(1)).alias("posts"), F.count(F.when(on_a, 1)).alias("n_A"),
        F.count(F.when(~on_a, 1)).alias("n_B")), "token_df")
    held = dfreq.agg(F.sum("n_A").alias("A"), F.sum("n_B").alias("B")).first()
    held = {side: int(held[side] or 0) for side in "AB"}
    small = min("AB", key=lambda side: held[side])
    if held[small] <= SMALL_POSTINGS:
        pairs = _broadcast_pairs(vectors, dfreq, n_rows, small, held, float(threshold))
    else:
        n_docs = rows.sparkSession.range(1).select(F.lit(float(n_rows)).alias("_n"))
        wt = _weigh(posts.drop("m"), dfreq.select("token", "df", "posts"), n_docs, sum(held.values()))
        pairs = _indexed_pairs(materialise_table(wt, "tfidf"), sum(held.values()), float(threshold), postings_per_task)
    return TextPairs(pairs, chunks, copies, ids.select("side", "id"))


def _broadcast_pairs(vectors: DataFrame, dfreq: DataFrame, n_docs: int, small: str, held: dict[str, int],
                     threshold: float) -> DataFrame:
    """The pairs where the postings of the side ``small`` are few: its weights
    go to every vector of the other side, whose pairs add up in the task that
    holds the vector.

    The document frequencies of the frequent tokens, and of the small side's,
    are broadcast as well.  The other tokens, rare and not shared, only add to
    the norms: they alone are shuffled by token."""
    large = "B" if small == "A" else "A"
    shared = F.col(f"n_{small}") > 0
    known = F.col("posts") > sum(held.values()) // KNOWN_TOKENS
    lookup = F.broadcast(dfreq.where(known | shared).select("token", "df", shared.alias("_shared")))
    weight = F.col("tf") * _idf(F.lit(float(n_docs)), F.col("df"))
    square = F.col("w") * F.col("w")

    def terms(frame: DataFrame) -> DataFrame:
        return frame.select("id", F.explode("terms").alias("_t")).select("id", "_t.*")

    few = (terms(vectors.where(F.col("side") == small)).join(lookup, "token").withColumn("w", weight)
           .withColumn("w", F.col("w") / F.sqrt(F.sum(square).over(Window.partitionBy("id"))))
           .select("token", F.col("id").alias("_few"), F.col("w").alias("_w")))
    other = vectors.where(F.col("side") == large).select("id", "terms")
    rare = (terms(other).join(lookup.select("token"), "token", "left_anti")
            .join(dfreq.where(~(known | shared)).select("token", "df"), "token").withColumn("w", weight)
            .groupBy("id").agg(F.sum(square).alias("_rare")))
    spark = vectors.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held[large] // TASK_POSTINGS))
    norm = F.sqrt(F.col("_known") + F.coalesce("_rare", F.lit(0.0)))
    many = (terms(other.repartition(n, "id")).join(lookup, "token").withColumn("w", weight)
            .withColumn("_known", F.sum(square).over(Window.partitionBy("id"))).where("_shared")
            .join(rare, "id", "left").select("id", "token", (F.col("w") / norm).alias("w")))
    out = (many.join(F.broadcast(few), "token").groupBy("id", "_few").agg(F.sum(F.col("w") * F.col("_w")).alias("score"))
           .where(F.col("score") > F.lit(threshold)))
    first, second = ("_few", "id") if small == "A" else ("id", "_few")
    return out.select(F.col(first).alias("id_1"), F.col(second).alias("id_2"), "score")


def cosine_pairs(a: DataFrame, b: DataFrame, threshold: float,
                 id_col: str = "id", text_col: str = "text",
                 postings_per_task: int = 200_000) -> DataFrame:
    """(id_1 from A, id_2 from B, score) with score = dot product
    of the normalised vectors and ``score > threshold``: ``text_pairs`` for
    every document.  What only needs one document of a text, or the texts
    themselves, takes those (``class_pairs``) and not this result, which grows
    with the product of their copies."""
    return text_pairs(a, b, threshold, id_col, text_col, postings_per_task).expand()


def class_pairs(found: TextPairs, pairs: DataFrame | None = None) -> DataFrame:
    """T3/J11/C13 in classes, for a result that grows with the documents and the
    pairs of different texts, not with the product of copies: (kind, id_1, id_2,
    id, further columns of the pairs).

    A row of kind ``pair`` links the texts of A and B whose smallest ids are
    id_1 and id_2; a row ``member_1`` (``member_2``) says that the document id
    of A (B) has the text of id_1 (id_2).  Every document is a member, also of a
    text without a pair; joining the members to the pairs on id_1 and id_2 gives
    ``cosine_pairs``.  ``pairs``: the pairs of texts to show, if not all."""
    pairs = found.pairs if pairs is None else pairs
    on_a = F.col("side") == "A"
    members = found.membership().select(
        F.when(on_a, "member_1").otherwise("member_2").alias("kind"), F.when(on_a, F.col("class_id")).alias("id_1"),
        F.when(~on_a, F.col("class_id")).alias("id_2"), "id")
    return pairs.withColumn("kind", F.lit("pair")).unionByName(members, allowMissingColumns=True)


def _indexed_pairs(wt: DataFrame, postings: int, threshold: float, postings_per_task: int) -> DataFrame:
    """The pairs of two large sides.

    Candidates are the pairs sharing an indexed token whose bounds allow the
    threshold (``candidate_index``, ``candidate_pairs``; no pair reaching it is
    missed).  Their score is the indexed-token
    join's partial sum plus the shared tokens that sit in a tail: A-tail
    tokens looked up in B, and B-tail tokens looked up in the A prefix — each
    a join restricted to the candidates, so a frequent tail token never meets
    documents outside them."""
    b_all = wt.where(F.col("side") == "B").select("id", "token", "w", "df")
    ix = candidate_index(wt, threshold, postings=postings)
    a_pref = ix.where((F.col("side") == "A") & F.col("_pref")).select("id", "token", "w")
    a_tail = ix.where((F.col("side") == "A") & ~F.col("_pref") & (F.col("_mw") > 0))
    b_tail = ix.where((F.col("side") == "B") & ~F.col("_pref") & (F.col("_mw") > 0))
    head = materialise_table(candidate_pairs(ix, threshold, postings_per_task), "candidates")
    cand = head.select("id_1", "id_2")
    # shared tokens in the A tail (any place in B)
    t1 = (cand.join(a_tail.select(F.col("id").alias("id_1"), "token", F.col("w").alias("w1")), "id_1")
          .join(b_all.select(F.col("id").alias("id_2"), "token", F.col("w").alias("w2")), ["id_2", "token"])
          .select("id_1", "id_2", (F.col("w1") * F.col("w2")).alias("s")))
    # shared tokens in the B tail whose A side is indexed
    t2 = (cand.join(b_tail.select(F.col("id").alias("id_2"), "token", F.col("w").alias("w2")), "id_2")
          .join(a_pref.select(F.col("id").alias("id_1"), "token", F.col("w").alias("w1")), ["id_1", "token"])
          .select("id_1", "id_2", (F.col("w1") * F.col("w2")).alias("s")))
    scored = head.unionByName(t1).unionByName(t2).groupBy("id_1", "id_2").agg(F.sum("s").alias("score"))
    return scored.where(F.col("score") > F.lit(threshold))


def threshold_sets(pairs: DataFrame, thresholds=S.NOTEBOOK_SIMILARITY_THRESHOLDS) -> DataFrame:
    """T5: the labelled result sets '> t' for every threshold (pairs x a
    threshold table of a handful of rows, broadcast)."""
    spark = pairs.sparkSession
    th = spark.createDataFrame([(f"Filtered (>{t})", float(t)) for t in thresholds], "label string, t double")
    return pairs.crossJoin(F.broadcast(th)).where(F.col("score") > F.col("t")).drop("t")


def band(score_col: str = "score", bands=S.SIMILARITY_BANDS) -> F.Column:
    """C14: half-open band label 'Range lo-hi' with lo <= score < hi."""
    expr = None
    for lo, hi in bands:
        label = f"Range {lo}-{round(hi - 0.001, 3)}"
        cond = (F.col(score_col) >= lo) & (F.col(score_col) < hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def sample_bands(pairs: DataFrame, n: int = S.BAND_SAMPLE_SIZE, seed: int = S.BAND_SAMPLE_SEED,
                 bands=S.SIMILARITY_BANDS) -> DataFrame:
    """At most ``n`` pairs per band, chosen by a seeded hash of the
    pair (reproducible; not the rows a pandas sampler would pick).

    Exact top-n per band by hash, two-stage so a band holding most pairs is
    cut down in parallel first."""
    banded = pairs.withColumn("band", band("score", bands)).where(F.col("band").isNotNull())
    banded = banded.withColumn("_h", F.md5(F.concat_ws("-", F.lit(seed), "id_1", "id_2")))
    out = top_n_per_group(banded, ["band"], [F.col("_h"), F.col("id_1"), F.col("id_2")], n,
                          salt_key=F.col("_h"))
    return out.drop("_h")


def purge_identical(pairs: DataFrame | TextPairs, dead: DataFrame, product: DataFrame,
                    eps: float = 1e-9) -> tuple[DataFrame | TextPairs, DataFrame, DataFrame]:
    """Dead items with a score-1 partner leave the dead-stock table and
    the product table, and all their pairs go (set-wise; the sold side is
    never dead stock).  Returns (pairs, dead, product), the pairs as given: of
    documents or of texts."""
    texts = isinstance(pairs, TextPairs)
    found = materialise_table(pairs.pairs, "text_pairs") if texts else pairs
    equal = found.where(F.col("score") >= 1.0 - eps).select(F.col("id_2").alias("id")).distinct()
    gone = (pairs.members("B", equal) if texts else equal).withColumnRenamed("id", S.ITEM_ID)
    left = (replace(pairs, pairs=found).without("B", equal) if texts else
            found.join(equal.withColumnRenamed("id", "id_2"), "id_2", "left_anti").select(*found.columns))
    return (left,
            dead.join(gone, S.ITEM_ID, "left_anti"),
            product.join(gone, S.ITEM_ID, "left_anti"))
