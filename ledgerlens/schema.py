"""Column names, types and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical column names of the cleaned ledger (one row per receipt line).
NOTA = "kode_nota"        # receipt id
DATE = "tanggal"          # sale timestamp
ITEM_ID = "id_barang"     # product id
NAME = "deskripsi_brg"    # product name
GROUP = "jenis_barang"    # product group
QTY = "jml"               # quantity
PLATFORM = "platform"     # sales channel
SOURCE = "source"         # source file of a line

# Raw ledger columns as they arrive from the shop's exports.
RAW_NOTA, RAW_DATE, RAW_NAME, RAW_GROUP, RAW_QTY = (
    "Kode Nota", "Tanggal", "Deskripsi Brg", "Jenis Barang", "Jml")
RAW_COLUMNS = [RAW_NOTA, RAW_DATE, RAW_NAME, RAW_GROUP, RAW_QTY]

RULE_SCHEMA = T.StructType([
    T.StructField("antecedent", T.ArrayType(T.StringType()), False),
    T.StructField("consequent", T.ArrayType(T.StringType()), False),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("lift", T.DoubleType(), True),
    T.StructField("support", T.DoubleType(), False),
])

# --------------------------------------------------------------------------
# FIXED VALUES — must equal the values the original analysis used.
# --------------------------------------------------------------------------

# Product type keywords, in precedence order (first type that matches wins).
TYPE_KEYWORDS = [
    ("chainsaw", ["CHAINSAW", "CHAIN SAW"]),
    ("accessories", ["ACCESORIS", "AKSESORIS", "CUCI GDG B", "LAKER", "SELANG", "BAUT"]),
    ("powertool", ["POWER TOOLS", "PT"]),
    ("teknik", ["TEKNIK"]),
    ("welding", ["WELDING"]),
    ("lubricant", ["LUBRICANT"]),
    ("mesin", ["MESIN", "DIESEL", "SPARE PART"]),
]
OTHER_TYPE = "other"

# Frequency / monetary cut points per product type (score 5, 4, 3, 2).
F_THRESHOLDS = {
    "powertool": [1200, 300, 100, 50],
    "teknik": [600, 150, 50, 25],
    "accessories": [300, 75, 25, 12],
    "mesin": [1200, 300, 100, 50],
    "chainsaw": [600, 150, 50, 25],
    "lubricant": [1200, 300, 100, 50],
    "welding": [600, 150, 50, 25],
}
M_THRESHOLDS = {
    "powertool": [2500, 600, 200, 100],
    "teknik": [1250, 300, 100, 50],
    "accessories": [600, 150, 50, 25],
    "mesin": [2500, 600, 200, 100],
    "chainsaw": [1250, 300, 100, 50],
    "lubricant": [2500, 600, 200, 100],
    "welding": [1250, 300, 100, 50],
}
UNKNOWN_TYPE_THRESHOLDS = [0, 0, 0, 0]

# Flat cut points (score 5, 4, 3, 2).
FLAT_F_THRESHOLDS = [1200, 600, 300, 120]
FLAT_M_THRESHOLDS = [6000, 3000, 1200, 120]
# Recency bands in days: 0 -> 5, 1..7 -> 4, 8..30 -> 3, 31..90 -> 2, else 1.
RECENCY_BANDS = [(0, 0, 5), (1, 7, 4), (8, 30, 3), (31, 90, 2)]

# Segment labels.
CAT_TRENDING = "Barang Naik Daun (Trending Products)"
CAT_FAST = "Barang Fast Moving"
CAT_LOYAL = "Barang Loyal (Loyal Products)"
CAT_POTENTIAL = "Barang Potensial (Potential Products)"
CAT_AVERAGE = "Barang Sedang (Average Products)"
CAT_STAGNANT = "Barang Stagnan (Stagnant Products)"
CAT_DEADSTOCK = "Deadstock (Non-Moving Products)"
CAT_CONSUMABLE = "Barang Habis Pakai"
CAT_UNCATEGORIZED = "Uncategorized"

DEADSTOCK_FLAG = "100"          # value of the DS column that marks dead stock
UNKNOWN_CATEGORY = "Unknown"    # category of an item missing from the map

# Association-rule presets per platform: (min support, min confidence).
RULE_PARAMS = {
    "General": (0.001, 0.3),
    "Shopee": (0.005, 0.1),
    "Tokopedia": (0.003, 0.4),
    "Lazada": (0.01, 0.2),
}
RULE_PARAMS_DEFAULT = (0.005, 0.5)
DEADSTOCK_RULE_PARAMS = {
    "General": (0.0005, 0.5),
    "Shopee": (0.005, 0.5),
    "Tokopedia": (0.005, 0.5),
    "Lazada": (0.03, 0.5),
}
DEADSTOCK_RULE_PARAMS_DEFAULT = (0.005, 0.5)

# Parameter grids: (supports, confidences), support outer loop.
DEADSTOCK_GRIDS = {
    "General": ([0.001, 0.0005, 0.0004, 0.0003], [0.5, 0.3, 0.1]),
    "Shopee": ([0.01, 0.005, 0.003], [0.8, 0.5, 0.1]),
    "Tokopedia": ([0.01, 0.005, 0.003], [0.8, 0.5, 0.1]),
    "Lazada": ([0.02, 0.015, 0.01], [0.8, 0.5, 0.1]),
    "Lazada V2": ([0.03, 0.015, 0.01], [0.8, 0.5, 0.1]),
}
ALL_PRODUCT_GRIDS = {
    "General": ([0.005, 0.001, 0.0007], [0.5, 0.3, 0.1]),
    "Shopee": ([0.01, 0.005, 0.001], [0.5, 0.3, 0.1]),
    "Tokopedia": ([0.01, 0.003, 0.001], [0.7, 0.4, 0.1]),
    "Lazada": ([0.01, 0.006, 0.003], [0.7, 0.4, 0.2]),
}

# Similarity thresholds.
APP_SIMILARITY_THRESHOLD = 0.3
NOTEBOOK_SIMILARITY_THRESHOLDS = [0.1, 0.3, 0.5]
# Sampling bands: [lo, hi) with at most 50 pairs each, seed 42.
SIMILARITY_BANDS = [(0.1, 0.2), (0.2, 0.3), (0.3, 0.4), (0.4, 0.5), (0.5, 0.6)]
BAND_SAMPLE_SIZE = 50
BAND_SAMPLE_SEED = 42
PAIR_PRECISION_KS = [50, 100, 150, 200, 250]

# Token pattern: runs of two or more letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Trailing windows that may be chosen, in years.
TREND_YEARS = [1, 2, 3]

# Basket statistics.
HISTOGRAM_CAP = 20
PAGE_ROWS = 10
