"""Column expressions (C*, F*, G1-G7, T1).

Every function here returns a ``Column`` built from ``pyspark.sql.functions``,
so it runs inside whole-stage codegen; none of them starts a job.

Scalar function families of SURVEY §2.8 and where they live:

* F1 string — ``normalise_name``, ``clean_product_name``, ``product_type``
  (upper + contains).
* F2 regex — ``clean_qty_text`` (``[^0-9.]``), ``tokens``;
  ``joins.order_sheets`` / ``evaluate.rules_before_first_invalid`` read
  ``Sup…`` / ``Conf…`` back out of a sheet label.
* F3 date — ``coerce_timestamp``; ``segment.trailing_window`` and
  ``segment.rfm_metrics`` (max, minus a year interval, whole days between).
* F4 math — ``similarity.tfidf`` (ln, sqrt), ``evaluate.page`` (ceil),
  percentages in ``baskets`` / ``evaluate``.
* F5 conditional — ``score_recency``, ``score_cuts``, ``category_rfm``,
  ``category_fm`` (chained ``when``).
* F6 array — ``sorted_text``, ``rule_key``, ``baskets.baskets``
  (``collect_set``), ``rules.rule_categories`` (``posexplode``).
* F7 map — ``score_by_type`` (a literal map of a handful of keys).
* F8 list from text — ``joins.parse_list_text``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- cleaning

def coerce_timestamp(col, dtype: T.DataType | None = None) -> Column:
    """Parse to timestamp; unparsable values become null.

    Besides ISO text, ``a/b/yyyy`` is read month first, and day first where
    ``a`` cannot be a month.  A column that is a timestamp or date already
    (``dtype``) is not parsed again."""
    c = _c(col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    text = F.trim(c.cast("string"))
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("M/d/yyyy")),
                      F.try_to_timestamp(text, F.lit("d/M/yyyy")))


def coerce_qty_int(col) -> Column:
    """C4: numeric coercion then truncation toward zero; unparsable -> null.
    Only plain numbers count: no type suffix ('3d'), no 'inf' or 'nan'."""
    text = F.trim(_c(col).cast("string"))
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text)
    return number.try_cast("double").try_cast("int")


def clean_qty_text(col) -> Column:
    """Trim, ',' -> '.', strip everything but digits and '.', coerce.

    The sign is stripped with the rest, so returns become positive; a value
    with two dots becomes null.
    """
    c = F.trim(_c(col).cast("string"))
    c = F.regexp_replace(F.regexp_replace(c, ",", "."), r"[^0-9.]", "")
    # Digits with at most one dot parse; empty, '.', or two dots -> null.
    return F.when(c.rlike(r"^[0-9]*\.?[0-9]*$") & c.rlike(r"[0-9]"), c.cast("double"))


def normalise_name(col) -> Column:
    """Lower-case and trim."""
    return F.lower(F.trim(_c(col)))


def clean_product_name(col) -> Column:
    """Trim, then drop newlines, double and single quotes."""
    return F.regexp_replace(F.trim(_c(col)), "[\n\"']", "")


def decode_validity(col, mode: str = "x") -> Column:
    """Mode 'x' -> 'x' is invalid (0), anything else incl. null valid (1);
    mode 'int' -> integer cast."""
    c = _c(col)
    if mode == "x":
        return F.when(c.cast("string") == "x", F.lit(0)).otherwise(F.lit(1))
    return c.cast("int")


# ------------------------------------------------------------ segmentation

def product_type(col, keywords: Sequence[tuple[str, Sequence[str]]] = S.TYPE_KEYWORDS) -> Column:
    """First type (in declared order) whose keyword occurs in the
    upper-cased group, else 'other'."""
    up = F.upper(F.coalesce(_c(col).cast("string"), F.lit("None")))
    expr = None
    for type_name, words in keywords:
        cond = None
        for w in words:
            cond = up.contains(w) if cond is None else (cond | up.contains(w))
        expr = F.when(cond, F.lit(type_name)) if expr is None else expr.when(cond, F.lit(type_name))
    return expr.otherwise(F.lit(S.OTHER_TYPE)) if expr is not None else F.lit(S.OTHER_TYPE)


def score_recency(days) -> Column:
    """0 -> 5, 1..7 -> 4, 8..30 -> 3, 31..90 -> 2, else 1."""
    d = _c(days)
    expr = None
    for lo, hi, score in S.RECENCY_BANDS:
        cond = (d >= lo) & (d <= hi)
        expr = F.when(cond, F.lit(score)) if expr is None else expr.when(cond, F.lit(score))
    return expr.otherwise(F.lit(1))


def score_cuts(value, cuts: Sequence[float]) -> Column:
    """>= cuts[0] -> 5, >= cuts[1] -> 4, >= cuts[2] -> 3,
    >= cuts[3] -> 2, else 1."""
    v = _c(value)
    return (F.when(v >= cuts[0], 5).when(v >= cuts[1], 4)
            .when(v >= cuts[2], 3).when(v >= cuts[3], 2).otherwise(1))


def score_by_type(value, type_col, table: dict[str, Sequence[float]],
                  default: Sequence[float] = S.UNKNOWN_TYPE_THRESHOLDS) -> Column:
    """Cut points looked up by product type; unknown types use
    ``default`` (all zeros: 5 for any value >= 0)."""
    keys, vals = [], []
    for k, cuts in table.items():
        keys.append(F.lit(k))
        vals.append(F.array(*[F.lit(float(x)) for x in cuts]))
    m = F.map_from_arrays(F.array(*keys), F.array(*vals))
    cuts = F.coalesce(F.element_at(m, _c(type_col)),
                      F.array(*[F.lit(float(x)) for x in default]))
    v = _c(value)
    return (F.when(v >= cuts[0], 5).when(v >= cuts[1], 4)
            .when(v >= cuts[2], 3).when(v >= cuts[3], 2).otherwise(1))


def category_rfm(r, f, m) -> Column:
    """Ladder A (recency-aware), first match wins."""
    R, Fs, M = _c(r), _c(f), _c(m)
    return (F.when((R > 3) & (Fs > 4), S.CAT_TRENDING)
            .when((R > 3) & (Fs > 3), S.CAT_FAST)
            .when((R > 4) & (Fs < 3), S.CAT_LOYAL)
            .when((R > 4) & (Fs > 3) & (Fs < 5), S.CAT_POTENTIAL)
            .when((Fs > 1) & (Fs < 5) & (M < 4), S.CAT_AVERAGE)
            .when((R > 2) & (Fs <= 2), S.CAT_STAGNANT)
            .when((Fs < 2) & (M < 2), S.CAT_DEADSTOCK)
            .when(M > 1, S.CAT_CONSUMABLE)
            .otherwise(S.CAT_UNCATEGORIZED))


def category_fm(f, m) -> Column:
    """Ladder B (frequency / monetary only), first match wins."""
    Fs, M = _c(f), _c(m)
    return (F.when(Fs > 4, S.CAT_TRENDING)
            .when(Fs > 3, S.CAT_FAST)
            .when((M > 4) & (Fs < 3), S.CAT_LOYAL)
            .when((M > 3) & (Fs > 3) & (Fs < 5), S.CAT_POTENTIAL)
            .when((Fs > 1) & (Fs < 5) & (M < 4), S.CAT_AVERAGE)
            .when((M > 3) & (Fs <= 2), S.CAT_STAGNANT)
            .when((Fs < 2) & (M < 2), S.CAT_DEADSTOCK)
            .when(M > 1, S.CAT_CONSUMABLE)
            .otherwise(S.CAT_UNCATEGORIZED))


# ------------------------------------------------------------------- text

def tokens(col, pattern: str = S.TOKEN_PATTERN) -> Column:
    """Lower-case, then every maximal run of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(_c(col).cast("string")), F.lit(pattern), 0)


# ------------------------------------------------------------------ arrays

def sorted_text(col, sep: str = ", ") -> Column:
    """array -> sorted, separator-joined text (reports and comparison)."""
    return F.array_join(F.array_sort(_c(col)), sep)


def rule_key(ante, cons) -> Column:
    """Canonical rule identity: both sides sorted, joined with control
    characters that cannot occur in a product name."""
    return F.concat_ws("\u0002", F.concat_ws("\u0001", F.array_sort(_c(ante))),
                       F.concat_ws("\u0001", F.array_sort(_c(cons))))


def sheet_label(support: float, confidence: float) -> str:
    """Grid cell label as the notebook prints it (Python float text)."""
    return f"Sup{support}_Conf{confidence}_Rules"


def row_hash(df) -> Column:
    """A row's 64-bit hash over all columns by name, as an exact decimal, so
    that sums over any number of rows neither overflow nor depend on the order
    of rows or columns.  Names stand between the values: a null counts where
    it is."""
    parts = [x for c in sorted(df.columns) for x in (F.lit(c), F.col(f"`{c}`"))]
    return F.xxhash64(*parts).cast("decimal(38,0)")
