"""SQL building blocks for the DuckDB oracles (one CTE per stage).

Oracle outputs follow the comparison rules: doubles rounded to 6 places,
arrays as sorted ', '-joined text, counts as BIGINT.
"""

from __future__ import annotations

from collections.abc import Sequence

from .. import schema as S


def lit_d(x: float) -> str:
    """A double literal (DuckDB reads 0.005 as DECIMAL otherwise)."""
    return f"CAST({x!r} AS DOUBLE)"


def sales_cte(platform: bool = False, source: bool = False, years: int | None = None,
              name: str = "p.p_name") -> str:
    """``lines``: kode_nota, tanggal, id_barang, deskripsi_brg, jenis_barang, jml."""
    extra = []
    joins = ""
    if platform:
        extra.append("c.c_mktsegment AS platform")
        joins += " JOIN customer c ON o.o_custkey = c.c_custkey"
    if source:
        extra.append("o.o_orderpriority AS source")
    cols = ", ".join(["l.l_orderkey AS kode_nota", "o.o_orderdate AS tanggal",
                      "l.l_partkey AS id_barang", f"{name} AS deskripsi_brg",
                      "p.p_type AS jenis_barang", "l.l_quantity AS jml"] + extra)
    base = (f"all_lines AS (SELECT {cols} FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
            f" JOIN part p ON l.l_partkey = p.p_partkey{joins})")
    if years is None:
        return base + ", lines AS (SELECT * FROM all_lines)"
    return (base + f", lines AS (SELECT * FROM all_lines WHERE tanggal >= "
            f"(SELECT max(tanggal) FROM all_lines) - INTERVAL {int(years)} YEAR)")


def multi_item_cte(src: str = "lines", item: str = "deskripsi_brg", name: str = "mlines") -> str:
    """C11: lines of receipts with more than one non-null item row."""
    return (f"{name} AS (SELECT * FROM {src} WHERE kode_nota IN (SELECT kode_nota FROM {src} "
            f"WHERE {item} IS NOT NULL GROUP BY kode_nota HAVING count({item}) > 1))")


def baskets_cte(src: str, item: str, name: str = "bk") -> str:
    """A3: distinct items per receipt as a sorted list of text."""
    return (f"{name} AS (SELECT kode_nota, list_sort(list(DISTINCT CAST({item} AS VARCHAR))) AS items "
            f"FROM {src} WHERE {item} IS NOT NULL GROUP BY kode_nota)")


def rules_ctes(bk: str, min_support: float, min_conf: float, prefix: str = "") -> str:
    """Exact association rules by enumerating every subset of every basket
    (baskets here hold at most a handful of items), then one consequent per
    rule.  Produces ``{prefix}rules``(ante, cons, cnt, confidence, lift,
    support) and ``{prefix}n``."""
    p = prefix
    return f"""
{p}n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {bk}),
{p}subsets AS (SELECT list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS iset
  FROM {bk}, range(1, (1 << len(items))) t(m)),
{p}freq AS (SELECT iset, count(*) AS cnt FROM {p}subsets GROUP BY iset
  HAVING count(*) >= (SELECT ceil({lit_d(min_support)} * n) FROM {p}n)),
{p}cand AS (SELECT list_filter(f.iset, lambda x: x <> c) AS ante, [c] AS cons, f.cnt
  FROM {p}freq f, unnest(f.iset) u(c) WHERE len(f.iset) >= 2),
{p}rules AS (SELECT r.ante, r.cons, r.cnt,
  CAST(r.cnt AS DOUBLE) / a.cnt AS confidence,
  (CAST(r.cnt AS DOUBLE) / a.cnt) / (CAST(q.cnt AS DOUBLE) / (SELECT n FROM {p}n)) AS lift,
  CAST(r.cnt AS DOUBLE) / (SELECT n FROM {p}n) AS support
  FROM {p}cand r JOIN {p}freq a ON a.iset = r.ante JOIN {p}freq q ON q.iset = r.cons
  WHERE CAST(r.cnt AS DOUBLE) / a.cnt >= {lit_d(min_conf)})"""


def grid_values(supports: Sequence[float], confs: Sequence[float]) -> str:
    """The grid as a VALUES list: sheet, min_support, min_confidence, grid_ord."""
    from ..functions.columns import sheet_label
    rows = []
    for i, s in enumerate(supports):
        for j, c in enumerate(confs):
            rows.append(f"('{sheet_label(s, c)}', {lit_d(s)}, {lit_d(c)}, {i * len(confs) + j})")
    return "(VALUES " + ", ".join(rows) + ") g(sheet, min_support, min_confidence, grid_ord)"


def rule_key_sql(ante: str, cons: str) -> str:
    return (f"concat_ws(chr(2), array_to_string(list_sort({ante}), chr(1)), "
            f"array_to_string(list_sort({cons}), chr(1)))")


def txt(col: str) -> str:
    """Sorted ', '-joined text of a list."""
    return f"array_to_string(list_sort({col}), ', ')"


DEADSTOCK = S.CAT_DEADSTOCK


def cuts_case(value: str, cuts) -> str:
    """G3/G4 as SQL."""
    return (f"CASE WHEN {value} >= {cuts[0]} THEN 5 WHEN {value} >= {cuts[1]} THEN 4 "
            f"WHEN {value} >= {cuts[2]} THEN 3 WHEN {value} >= {cuts[3]} THEN 2 ELSE 1 END")


def recency_case(days: str) -> str:
    """G2 as SQL."""
    parts = " ".join(f"WHEN {days} BETWEEN {lo} AND {hi} THEN {sc}" for lo, hi, sc in S.RECENCY_BANDS)
    return f"CASE {parts} ELSE 1 END"


def type_case(group: str, keywords=S.TYPE_KEYWORDS) -> str:
    """G1 as SQL."""
    up = f"upper(coalesce(CAST({group} AS VARCHAR), 'None'))"
    whens = []
    for t, words in keywords:
        cond = " OR ".join(f"contains({up}, '{w}')" for w in words)
        whens.append(f"WHEN {cond} THEN '{t}'")
    return f"CASE {' '.join(whens)} ELSE '{S.OTHER_TYPE}' END"


def typed_cuts_case(value: str, type_col: str, table, default=S.UNKNOWN_TYPE_THRESHOLDS) -> str:
    """G5 as SQL: a CASE per type choosing the score."""
    whens = [f"WHEN {type_col} = '{t}' THEN {cuts_case(value, cuts)}" for t, cuts in table.items()]
    return f"CASE {' '.join(whens)} ELSE {cuts_case(value, default)} END"


def ladder_a(r: str, f: str, m: str) -> str:
    """G6 as SQL."""
    return (f"CASE WHEN {r} > 3 AND {f} > 4 THEN '{S.CAT_TRENDING}' "
            f"WHEN {r} > 3 AND {f} > 3 THEN '{S.CAT_FAST}' "
            f"WHEN {r} > 4 AND {f} < 3 THEN '{S.CAT_LOYAL}' "
            f"WHEN {r} > 4 AND {f} > 3 AND {f} < 5 THEN '{S.CAT_POTENTIAL}' "
            f"WHEN {f} > 1 AND {f} < 5 AND {m} < 4 THEN '{S.CAT_AVERAGE}' "
            f"WHEN {r} > 2 AND {f} <= 2 THEN '{S.CAT_STAGNANT}' "
            f"WHEN {f} < 2 AND {m} < 2 THEN '{S.CAT_DEADSTOCK}' "
            f"WHEN {m} > 1 THEN '{S.CAT_CONSUMABLE}' ELSE '{S.CAT_UNCATEGORIZED}' END")


def ladder_b(f: str, m: str) -> str:
    """G7 as SQL."""
    return (f"CASE WHEN {f} > 4 THEN '{S.CAT_TRENDING}' "
            f"WHEN {f} > 3 THEN '{S.CAT_FAST}' "
            f"WHEN {m} > 4 AND {f} < 3 THEN '{S.CAT_LOYAL}' "
            f"WHEN {m} > 3 AND {f} > 3 AND {f} < 5 THEN '{S.CAT_POTENTIAL}' "
            f"WHEN {f} > 1 AND {f} < 5 AND {m} < 4 THEN '{S.CAT_AVERAGE}' "
            f"WHEN {m} > 3 AND {f} <= 2 THEN '{S.CAT_STAGNANT}' "
            f"WHEN {f} < 2 AND {m} < 2 THEN '{S.CAT_DEADSTOCK}' "
            f"WHEN {m} > 1 THEN '{S.CAT_CONSUMABLE}' ELSE '{S.CAT_UNCATEGORIZED}' END")


def rfm_cte(src: str, key: str, name: str = "rfm") -> str:
    """A1: recency / frequency / monetary per key."""
    return (f"{name} AS (SELECT {key} AS item, "
            f"CAST(floor((epoch_us((SELECT max(tanggal) FROM {src})) - epoch_us(max(tanggal))) / 86400000000) AS INTEGER) AS recency, "
            f"count(DISTINCT kode_nota) AS frequency, coalesce(sum(jml), 0) AS monetary "
            f"FROM {src} WHERE {key} IS NOT NULL GROUP BY {key})")


def v1_cte(src: str, key: str, name: str = "seg", f_cuts=S.FLAT_F_THRESHOLDS,
           m_cuts=S.FLAT_M_THRESHOLDS) -> str:
    """V1 segmentation: (item, recency, frequency, monetary, r/f/m scores, category)."""
    return (rfm_cte(src, key, name + "_m") + ", "
            f"{name}_s AS (SELECT *, {recency_case('recency')} AS r_score, "
            f"{cuts_case('frequency', f_cuts)} AS f_score, "
            f"{cuts_case('monetary', m_cuts)} AS m_score FROM {name}_m), "
            f"{name} AS (SELECT *, {ladder_a('r_score', 'f_score', 'm_score')} AS category FROM {name}_s)")


def deadstock_report_cte(years: int = 1, name: str = "p.p_name") -> str:
    """Parts with no sale in the last ``years``: dead(id_barang, deskripsi_brg, jenis_barang)."""
    return (f"ref AS (SELECT max(o_orderdate) AS r FROM orders), "
            f"recent_parts AS (SELECT DISTINCT l.l_partkey FROM lineitem l JOIN orders o "
            f"ON l.l_orderkey = o.o_orderkey WHERE o.o_orderdate >= (SELECT r FROM ref) - INTERVAL {int(years)} YEAR), "
            f"dead AS (SELECT p_partkey AS id_barang, {name} AS deskripsi_brg, p_type AS jenis_barang FROM part p "
            f"WHERE p_partkey NOT IN (SELECT l_partkey FROM recent_parts))")


def tfidf_ctes(a_sql: str, b_sql: str, prefix: str = "") -> str:
    """T1/T2 over A (id, text) and B (id, text): ``{p}w``(side, id, token, w)."""
    p = prefix
    return f"""
{p}docs AS (SELECT 'A' AS side, id, text FROM ({a_sql}) UNION ALL SELECT 'B', id, text FROM ({b_sql})),
{p}toks AS (SELECT side, id, unnest(regexp_extract_all(lower(CAST(text AS VARCHAR)), '{S.TOKEN_PATTERN}')) AS token FROM {p}docs),
{p}tc AS (SELECT side, id, token, count(*) AS tf FROM {p}toks GROUP BY side, id, token),
{p}ndocs AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {p}docs),
{p}dfreq AS (SELECT token, count(*) AS df FROM {p}tc GROUP BY token),
{p}raw AS (SELECT tc.side, tc.id, tc.token, tc.tf * (ln((1 + (SELECT n FROM {p}ndocs)) / (1 + d.df)) + 1) AS w
  FROM {p}tc tc JOIN {p}dfreq d USING (token)),
{p}nrm AS (SELECT side, id, sqrt(sum(w * w)) AS nn FROM {p}raw GROUP BY side, id),
{p}w AS (SELECT r.side, r.id, r.token, r.w / n.nn AS w FROM {p}raw r JOIN {p}nrm n USING (side, id))"""


def cosine_cte(prefix: str = "", name: str = "pairs") -> str:
    """(id_1, id_2, score) for pairs sharing a token."""
    p = prefix
    return (f"{name} AS (SELECT a.id AS id_1, b.id AS id_2, sum(a.w * b.w) AS score "
            f"FROM {p}w a JOIN {p}w b ON a.token = b.token AND a.side = 'A' AND b.side = 'B' "
            f"GROUP BY a.id, b.id)")
