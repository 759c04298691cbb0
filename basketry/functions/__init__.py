from basketry.functions.columns import (
    category_label,
    differs_from,
    file_stamp,
    grid,
    lacks_words,
    min_max,
    parse_timestamp,
)

__all__ = [
    "category_label",
    "differs_from",
    "file_stamp",
    "grid",
    "lacks_words",
    "min_max",
    "parse_timestamp",
]
