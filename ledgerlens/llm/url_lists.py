"""URL filter by a temporal list join.

A list is a log of dated entries: from ``effective`` on, a key is blocked,
allowed or removed.  Entries become validity intervals, and each capture is
judged by the entries that were valid when it was fetched: an as-of join on
key and time.  Times are seconds since 1970.

Kinds of keys, the more telling first: ``url`` (a whole URL without its
fragment), ``prefix`` (host and leading folders, ending in ``/``), ``host``,
``domain`` (a host or any domain above it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, narrow

KINDS = ["url", "prefix", "host", "domain"]
#: Width of the time buckets of the join: 30 days.
BUCKET = 30 * 86_400
#: Copies of a list entry, one for each share of a hot key's captures.
SALTS = 8

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
_AUTHORITY = _SCHEME + r"([^/?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    authority = F.regexp_extract(url, _AUTHORITY, 2)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY + r"([^?#]*)", 3)


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no user, port or fragment."""
    rest = F.regexp_extract(url, _AUTHORITY + r"([^#]*)", 3)
    return F.concat(F.lower(F.regexp_extract(url, _SCHEME, 1)), F.lit("://"), host_of(url), rest)


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, key, action, valid_from, valid_to (null: open) from a log
    of list, kind, key, action, effective.

    An entry holds until the key's next one; ``remove`` holds nothing.  Of
    entries for one moment the alphabetically last action counts.  Entries
    with a null in any of these columns or another kind are left out."""
    log = entries.select("list", "kind", "key", "action", "effective").dropna().where(F.col("kind").isin(KINDS))
    one = log.groupBy("list", "kind", "key", "effective").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "kind", "key").orderBy("effective")
    return (one.withColumn("valid_to", F.lead("effective").over(w))
            .where("action != 'remove'")
            .select("list", "kind", "key", "action", F.col("effective").alias("valid_from"), "valid_to"))


def candidate_keys(url: Column, depth: int) -> Column:
    """All keys of a URL that a list could have: array of (kind, key).
    ``depth``: folders of the list's longest prefix."""
    host, parts = host_of(url), F.split(path_of(url), "/")
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    folders = F.least(F.size(parts) - 1, F.lit(depth))
    prefixes = F.when(folders >= 1, F.transform(F.sequence(F.lit(1), F.greatest(folders, F.lit(1))), lambda i: key(
        "prefix", F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))).otherwise(F.array())
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: key(
        "domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    keys = F.concat(F.array(key("url", normal_url(url)), key("host", host)), prefixes, domains)
    return F.when(host != "", keys).otherwise(F.array())


def judge(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
          time_col: str = "fetched_at", bucket: int = BUCKET, salts: int = SALTS) -> DataFrame:
    """One row per distinct capture: page_id, url, fetched_at, blocked, and of
    the entry that decided list, kind, key, valid_from, valid_to.

    The most telling kind decides, then the longest key, then the list's name;
    without a valid entry a capture is not blocked and these are null.

    * null or unparsable URL, null time: not blocked; null id: an id like any
    * repeated rows are one capture; an empty list blocks nothing
    * empty table: no rows; further columns are not carried

    Keys are joined within time buckets.  Entries go to the buckets they are
    valid in (within the captures' times) and to ``salts`` shares of each, so a
    host with a third of all captures is spread over buckets and shares."""
    rows = narrow(captures, page_id=id_col, url=url_col, fetched_at=time_col)
    valid = materialise(intervals(entries), "list-intervals")
    depth = valid.where("kind = 'prefix'").agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    span = rows.agg(F.min("fetched_at").alias("lo"), F.max("fetched_at").alias("hi")).first()
    default = rows.select("page_id", "url", "fetched_at", F.lit(None).cast(
        "struct<rank:int,short:int,list:string,kind:string,key:string,action:string,valid_from:bigint,valid_to:bigint>"
    ).alias("m"))
    if span.lo is None:
        hits = default.limit(0)
    else:
        at = lambda c: F.floor(c / F.lit(bucket)).cast("long")
        first = F.greatest("valid_from", F.lit(span.lo).cast("long"))
        last = F.least(F.coalesce(F.col("valid_to") - 1, F.lit(span.hi).cast("long")), F.lit(span.hi).cast("long"))
        dealt = (valid.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
                 .withColumn("_bucket", F.explode(F.sequence(at(F.col("_first")), at(F.col("_last")))))
                 .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).drop("_first", "_last"))
        keys = (rows.where("fetched_at is not null and url is not null")
                .withColumn("_k", F.explode(candidate_keys(F.col("url"), depth)))
                .select("page_id", "url", "fetched_at", F.col("_k.kind").alias("kind"), F.col("_k.key").alias("key"),
                        at(F.col("fetched_at")).alias("_bucket"),
                        F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.lit(salts)).cast("int").alias("_salt")))
        # always a shuffle: the list grows with the web, and its copies per
        # bucket and share are far larger than a size estimate of it says
        joined = keys.join(dealt.hint("merge"), ["kind", "key", "_bucket", "_salt"]).where(
            (F.col("valid_from") <= F.col("fetched_at"))
            & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
        rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
        hits = joined.select("page_id", "url", "fetched_at", F.struct(
            rank.alias("rank"), (-F.length("key")).alias("short"), "list", "kind", "key", "action",
            "valid_from", "valid_to").alias("m"))
    decided = default.unionByName(hits).groupBy("page_id", "url", "fetched_at").agg(F.min("m").alias("m"))
    return decided.select(
        "page_id", "url", "fetched_at", F.coalesce(F.col("m.action") == "block", F.lit(False)).alias("blocked"),
        "m.list", "m.kind", "m.key", "m.valid_from", "m.valid_to")


def keep_allowed(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                 time_col: str = "fetched_at") -> DataFrame:
    """``captures`` without those that the list blocked when they were
    fetched, all columns kept."""
    url, at = fresh(captures, "url"), fresh(captures, "at")
    out = materialise(judge(captures, entries, id_col=id_col, url_col=url_col, time_col=time_col)
                      .where("blocked").select(F.col("url").alias(url), F.col("fetched_at").alias(at))
                      .distinct(), "list-blocked")
    return captures.join(out, (F.col(f"`{url_col}`") == F.col(url)) & (F.col(f"`{time_col}`") == F.col(at)), "left_anti")
