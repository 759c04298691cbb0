"""Column expressions. All stay inside whole-stage code generation."""

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.schemas import CATEGORY_LABELS


def lacks_words(column: Column, words) -> Column:
    """True where the text holds none of the words in any case; null text stays null (dropped)."""
    lowered = F.lower(column)
    return reduce(
        lambda left, right: left & right,
        [~F.contains(lowered, F.lit(word.lower())) for word in words],
        column.isNotNull(),
    )


def differs_from(column: Column, value: str) -> Column:
    """True where the column is not the value; null counts as different."""
    return column.isNull() | (column != value)


def parse_timestamp(column: Column, pattern: str | None = None, strict: bool = True) -> Column:
    """Text to timestamp without zone. Strict raises on bad text, otherwise it becomes null."""
    fmt = F.lit(pattern) if pattern else None
    if strict:
        return F.to_timestamp_ntz(column, fmt) if pattern else F.to_timestamp_ntz(column)
    return F.try_to_timestamp(column, fmt).cast("timestamp_ntz")


def file_stamp(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def category_label(code: Column) -> Column:
    """Label of a category code, null for an unknown code."""
    pairs = chain.from_iterable(CATEGORY_LABELS.items())
    return F.create_map(*[F.lit(text) for text in pairs])[code]


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Rescale to 0..1; a column without spread gives 0."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def grid(value: Column, digits: int = 8) -> Column:
    """Round a non-negative number to a decimal grid with plain IEEE steps.

    Sums arrive in any order, so equal distances can differ in the last bit. Ranking on the grid
    makes such ties real ties, which the id then decides.
    """
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale
