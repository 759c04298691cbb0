"""Column layouts and fixed values shared by the whole package."""

from pyspark.sql.types import (
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _strings(*names):
    return [StructField(name, StringType()) for name in names]


RAW_PURCHASES = StructType(
    _strings("cont_id", "transaction_id")
    + [StructField("transaction_date", TimestampNTZType())]
    + _strings("prod_id", "prod_family", "prod_subfamily", "prod_name")
)

# File header of the category list, and the names used after reading it.
CATEGORY_FILE = StructType(
    _strings("category1", "category2", "famille_intitule", "sous_famille_intitule")
)
CATEGORY_KEYS = ["prod_family", "prod_subfamily"]

PRODUCT_KEYS = ["prod_family", "prod_subfamily", "prod_name"]

PURCHASES = StructType(
    _strings("cont_id", "transaction_id")
    + [StructField("transaction_date", TimestampNTZType())]
    + _strings("prod_id")
    + [StructField("model_id", LongType())]
    + _strings(*PRODUCT_KEYS, "category1", "category2", "CAT1")
)

MENU = StructType(_strings("CAT1", *PRODUCT_KEYS))

FEEDBACK_REQUESTS = StructType(
    _strings("client_id", "suggestion1", "suggestion2", "suggestion3")
)

ALL_RECOS = StructType(
    _strings("cont_id", *[f"recommendation_{i}" for i in range(1, 6)])
)

# Fixed values.
CATEGORY_LABELS = {
    "L": "LIVING ROOM",
    "D": "DINING ROOM",
    "B": "BEDROOM",
    "A": "ACCESSORIES",
    "O": "OTHER",
}
UNCATEGORISED = "X"
SUGGESTION = "suggestion"
NOT_A_PRODUCT = "SERVICES"
EXCLUDED_WORDS = ("spare", "service")
RECENCY_CUTOFF = "2015-04-23"
CORE_CATEGORIES = ("L", "D", "B")
WIDER_CATEGORIES = ("L", "D", "B", "A")
EMPTY_SLOT = " "

# Texts a CSV reader of the pandas family takes as missing.
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
