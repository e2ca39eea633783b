"""Operators that drop rows tell rows apart, whatever their ids and columns."""

from ledgerlens.llm import exact_dedup, ngram_join, url_lists

WORDS = [f"w{i}" for i in range(60)]
A, B = " ".join(WORDS), " ".join(reversed(WORDS))


def test_near_copies_go_by_row(spark):
    rows = [(1, A, "a"), (5, A + " w", "b"), (5, B, "c"), (None, A, "d"), (None, B + " x", "e"), (7, None, "f"), (7, "", "g"),
            (9, B, "h"), (9, B, "i"), (None, None, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _out string").withColumnRenamed("_out", "_key")
    kept = ngram_join.drop_similar(docs)
    assert kept.columns == docs.columns
    # of A's rows 1 stays, of B's that of 5; rows without an id stay
    assert sorted(r._key for r in kept.collect()) == ["a", "c", "d", "e", "f", "g", "j"]
    same = spark.createDataFrame([(3, A), (3, A), (4, A)], "doc_id long, text string")
    assert [r.doc_id for r in ngram_join.drop_similar(same).collect()] == [3, 3]
    assert ngram_join.drop_similar(docs.limit(0)).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, A, 1, 2, 3), (2, A, 1, 2, 3), (3, B, 1, 2, 3)],
                                 "doc_id long, text string, _out int, _k_id int, _k_sha int")
    for drop in (ngram_join.drop_similar, exact_dedup.drop_copies):
        kept = drop(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_clashing_columns_of_captures(spark):
    captures = spark.createDataFrame([(1, "http://a.b/x", 10, 0, 0), (2, "http://c.d/x", 10, 0, 0)],
                                     "page_id long, url string, fetched_at long, _url int, _at int")
    entries = spark.createDataFrame([("l", "host", "a.b", "block", 5)],
                                    "list string, kind string, key string, action string, effective long")
    kept = url_lists.keep_allowed(captures, entries)
    assert kept.columns == captures.columns and [r.page_id for r in kept.collect()] == [2]
