"""Corpus pipeline: language ID, exact dedup, n-gram Jaccard dedup, benchmark
decontamination and BPE over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet and reads it again as the next stage's docs.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontaminate, exact_dedup, langid, ngram_join
from ledgerlens.llm.common import fresh, fresh_dir, table
from ledgerlens.llm.queries import tokenizer_path


def language_stage(spark, docs, sf_dir):
    """Rejects documents that are in no language: without a letter or text.
    It rejects on letters alone; the network names a language for every other
    document and its probabilities reject none.  Without a labelled row to train
    on the documents with letters stay as well."""
    model = langid.train(docs)
    if not model.labels:
        return langid.lettered(docs)
    label, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = langid.detect(docs, model, label_col=label, score_col=score)
    return found.where(F.col(label) != langid.UNKNOWN).drop(label, score)


def exact_stage(spark, docs, sf_dir):
    """Of texts equal up to white space the one with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark, docs, sf_dir):
    """Of each component of documents whose five-word shingles have a Jaccard
    similarity of 0.8 or more the one with the smallest id stays."""
    return ngram_join.drop_similar(docs, n=5, percent=80)


def benchmark_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark, docs, sf_dir):
    """Adds ids (little-endian unsigned 32-bit), n_tokens, and whether the ids
    decode to the text."""
    tokenizer = bpe.Tokenizer(spark, tokenizer_path()).fit(docs)
    back = fresh(docs, "decoded")
    decoded = tokenizer.round_trip(docs, decoded_col=back)
    return (decoded.withColumn("n_tokens", F.expr("octet_length(ids) div 4").cast("long"))
            .withColumn("round_trip", F.col(back) == F.coalesce(F.col("text"), F.lit(""))).drop(back))


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("ngram_jaccard_join", near_stage),
          ("benchmark_decontamination", benchmark_stage), ("bpe", tokens_stage)]

#: SQL cannot express the trained stages; the tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
