"""Registered queries of this package and their DuckDB SQL.

``QUERIES[name](spark, sf_dir)`` applies an operator to its whole table with
production parameters.  ``ORACLES[name]`` exists where SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat, collocations, decontaminate, exact_dedup, langid, multiset_hash, ngram_join, sharding, spelling,
               token_files, url_lists, warc)
from .common import fresh_dir, table

#: The tokenizers file of the queries; any path of the same format will do.
TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# The tables have no fetch times and no block lists.  Both are derived from
# the pages: a time of the year 2024 from the page_id, and dated entries from
# the hosts, folders and addresses that occur, by their md5.
_T0, _DAY = 1_704_067_200, 86_400
#: kind, its key's SQL, one key in so many is listed
_LISTED = [("host", "host", 3), ("domain", "regexp_replace(host, '^[^.]+[.]', '')", 2),
           ("prefix", "concat(host, regexp_extract(path, '^/[^/]*/', 0))", 5), ("url", "norm", 40)]


def _entries_sql(number: str, pages: str) -> str:
    """A log of entries: each listed key is blocked one day, and two of three
    of them are allowed or removed some days later, one again blocked."""
    keys = " UNION ".join(f"SELECT DISTINCT '{k}' AS kind, {key} AS key, {every} AS every FROM {pages}"
                          for k, key, every in _LISTED)
    n = number.format("concat(kind, key)")
    return f"""
SELECT concat('list', CAST(n % 2 AS STRING)) AS list, kind, key, s.action,
       CAST({_T0} + {_DAY} * (n % 200 + s.days * (1 + n % 50)) AS BIGINT) AS effective
FROM (SELECT kind, key, {n} AS n FROM ({keys}) k WHERE {n} % every = 0) l
CROSS JOIN (VALUES ('block', 0, 0), ('allow', 1, 1), ('remove', 1, 2), ('block', 2, 1)) s(action, days, which)
WHERE s.which = 0 OR n % 3 = s.which"""


def op1_tables(spark, sf_dir):
    """(captures, list entries) derived from ``pages``."""
    captures = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.expr(f"CAST({_T0} + (page_id * 7919) % 527040 * 60 AS BIGINT)").alias("fetched_at"))
    url = F.col("url")
    parsed = captures.where("url is not null").select(
        url_lists.host_of(url).alias("host"), url_lists.path_of(url).alias("path"),
        url_lists.normal_url(url).alias("norm"))
    entries = spark.sql(_entries_sql("CAST(conv(substr(md5({}), 1, 6), 16, 10) AS BIGINT)", "{parsed}"), parsed=parsed)
    return captures, entries


@query("op1_temporal_url_lists", f"""
WITH captures AS (
  SELECT DISTINCT page_id, url, (({_T0} + (page_id * 7919) % 527040 * 60))::BIGINT AS fetched_at,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
parsed AS (SELECT *, regexp_replace(url, '#.*$', '') AS norm FROM captures WHERE url IS NOT NULL),
entries AS ({_entries_sql("('0x' || substr(md5({}), 1, 6))::BIGINT", "parsed")}),
valid AS (
  SELECT * FROM (SELECT *, effective AS valid_from,
                        lead(effective) OVER (PARTITION BY list, kind, key ORDER BY effective) AS valid_to FROM entries)
  WHERE action != 'remove'),
hits AS (
  SELECT c.page_id, c.url, c.fetched_at, v.action, v.list, v.kind, v.key, v.valid_from, v.valid_to,
    row_number() OVER (PARTITION BY c.page_id, c.url, c.fetched_at ORDER BY
      list_position(['url', 'prefix', 'host', 'domain'], v.kind), length(v.key) DESC, v.list) AS k
  FROM parsed c JOIN valid v ON v.valid_from <= c.fetched_at AND (v.valid_to IS NULL OR c.fetched_at < v.valid_to)
    AND CASE v.kind WHEN 'url' THEN c.norm = v.key WHEN 'host' THEN c.host = v.key
        WHEN 'domain' THEN c.host = v.key OR ends_with(c.host, '.' || v.key)
        ELSE starts_with(c.host || c.path, v.key) END)
SELECT c.page_id, c.url, c.fetched_at, coalesce(h.action = 'block', false) AS blocked,
       h.list, h.kind, h.key, h.valid_from, h.valid_to
FROM captures c LEFT JOIN hits h ON h.k = 1 AND h.page_id = c.page_id AND h.url = c.url
  AND h.fetched_at = c.fetched_at""")
def op1(spark, sf_dir):
    """All pages judged by the lists that held when they were fetched."""
    return url_lists.judge(*op1_tables(spark, sf_dir))


@query("op2_feistel_shards")
def op2(spark, sf_dir):
    """All documents into 16 shards by a Feistel permutation."""
    return sharding.feistel_shards(table(spark, sf_dir, "documents"), shards=16, seed=2)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op3_warc_dictionary", f"""
WITH p AS (SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id != first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id != first THEN first END AS refers_to
FROM g""")
def op3(spark, sf_dir):
    """All pages written as dictionary-compressed WARC files and read back."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))
    return warc.read_archives(manifest, with_payload=False).drop("url")


def _esc(expr: str) -> str:
    for raw, code in chat.CODES:
        expr = f"replace({expr}, '{raw}', '{code}')"
    return expr


@query("op4_chat_format", f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'),
                                  (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))),
marked AS (
  SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS head
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_esc('text')}) + CASE WHEN head = 1 THEN
      {len(chat.HEAD + chat.COLON + chat.END)} + length(replace({_esc('role')}, ':', '\\c'))
      ELSE {len(chat.JOIN)} END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id""")
def op4(spark, sf_dir):
    """All conversations and conversation -7, formatted and read back."""
    sample = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", sample), (-7, 1, "assistant", sample)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = chat.format_chats(rows.unionByName(extra))
    return chat.digest_chats(chat.read_chats(formatted))


@query("op5_transducer_bpe")
def op5(spark, sf_dir):
    """All documents encoded and decoded; the lexicon is fitted on them."""
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.Tokenizer(spark, tokenizer_path()).fit(docs), docs)


@query("op6_latent_decontamination")
def op6(spark, sf_dir):
    """Documents that hold a benchmark item, over all documents."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_gru_language")
def op7(spark, sf_dir):
    """The language of every whole text, by a network trained on the rows
    that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    return langid.detect(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op8_prefix_tree_join")
def op8(spark, sf_dir):
    """Components of all documents under 4-gram Jaccard of 0.85."""
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


@query("op9_exact_dedup", r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM hashed WINDOW g AS (PARTITION BY text_sha256)""")
def op9(spark, sf_dir):
    """Exact groups of all documents."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op10_arrow_token_files")
def op10(spark, sf_dir):
    """All documents' ids written as Arrow stream files and read back."""
    with open(tokenizer_path(), encoding="utf-8") as f:
        source = f.read()
    index = token_files.write_token_files(table(spark, sf_dir, "documents"),
                                          fresh_dir(spark, "token-files"), source, end_id=2)
    return token_files.read_token_files(index, with_ids=False)


@query("op11_multiset_hash")
def op11(spark, sf_dir):
    """All documents' fingerprints, beside those of their edited texts."""
    return multiset_hash.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op12_pivotal_grams", f"""
WITH RECURSIVE bits AS (
  SELECT i AS n, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)),
counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS x
            FROM runs WHERE length(run) >= {spelling.MIN_CHARS} GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) AS h FROM counted, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {spelling.THINNED} = 0 THEN substr(run, 1, (h % length(run))::BIGINT)
                || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {spelling.MIN_CHARS} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b
    ON a.less = b.less AND a.i = b.i AND a.word != b.word
  UNION SELECT a.word, a.n, w.word, w.n FROM cut a JOIN words w ON a.less = w.word
  UNION SELECT w.word, w.n, a.word, a.n FROM cut a JOIN words w ON a.less = w.word),
best AS (SELECT word, n, count(*) AS n_near, max(other_n) AS other_n, arg_min(other, (-other_n, other)) AS other
         FROM near GROUP BY word, n),
forms AS (SELECT word, n_near, CASE WHEN other_n >= {spelling.FORM_RATIO} * n THEN other END AS form,
                 CASE WHEN other_n >= {spelling.FORM_RATIO} * n THEN other_n END AS form_n FROM best),
way AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL
        UNION ALL SELECT way.word, f.form FROM way JOIN forms f ON f.word = way.at WHERE f.form IS NOT NULL),
ends AS (SELECT way.word, way.at AS root FROM way LEFT JOIN forms f ON f.word = way.at WHERE f.form IS NULL)
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN forms f ON f.word = w.word LEFT JOIN ends e ON e.word = w.word""")
def op12(spark, sf_dir):
    """All words of the documents with their variants."""
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


@query("op13_misra_gries", f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS g FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, {collocations.WORDS + 1}) t(k))),
f AS MATERIALIZED (SELECT lang, array_to_string(g, ' ') AS phrase, k, any_value(g) AS g, count(*) AS f
                   FROM grams GROUP BY lang, k, array_to_string(g, ' ')),
cand AS (SELECT * FROM f WHERE k >= 2 AND f >= {collocations.LEAST}),
longer AS (SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, unnest([array_to_string(g[1:2], ' '), array_to_string(g[2:3], ' ')]) AS phrase FROM cand WHERE k = 3)
  GROUP BY lang, phrase),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, c.g, cut FROM cand c LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase,
         range(1, 3) t(cut) WHERE cut < c.k AND (o.f IS NULL OR 100 * o.f < {collocations.INSIDE} * c.f)),
scored AS (
  SELECT u.lang, u.phrase, u.a, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * u.a * u.a) // (x.f::HUGEINT * y.f))::BIGINT AS score,
         row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY (1000000::HUGEINT * u.a * u.a) // (x.f::HUGEINT * y.f), cut) AS nth
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.g[1:cut], ' ')
              JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.g[cut + 1:], ' ')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
           FROM scored WHERE nth = 1),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, s.n, r.score FROM ranked r JOIN sizes s ON s.lang = r.lang
WHERE r.rank <= {collocations.TOP}""")
def op13(spark, sf_dir):
    """Every language's collocations over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
