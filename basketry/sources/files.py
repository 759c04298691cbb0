"""CSV in and out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basketry.functions import file_stamp, parse_timestamp
from basketry.schemas import CATEGORY_FILE, NULL_TEXTS, RAW_PURCHASES


def _text_scan(
    spark: SparkSession, path: str, schema: StructType, sep: str, multi_line: bool, mode: str
) -> DataFrame:
    """The columns of the schema, found by the names in the header; others are not read.

    ``multi_line`` is for quoted line ends (such a file is one task). ``mode`` says what becomes of
    malformed rows: they raise unless it is PERMISSIVE or DROPMALFORMED.
    """
    scan = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", mode)
        .csv(path)
    )
    missing = [n for n in schema.fieldNames() if n not in scan.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return scan.select(*schema.fieldNames())


def _missing_to_null(df: DataFrame, null_texts) -> DataFrame:
    return df.select(
        *[F.when(~F.col(c).isin(*null_texts), F.col(c)).alias(c) for c in df.columns]
    )


def read_purchases_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    date_pattern: str | None = None,
    strict_dates: bool = True,
    null_texts=NULL_TEXTS,
    multi_line: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Raw purchases. Ids stay text; dates are parsed, bad ones raise unless ``strict_dates`` is off."""
    scan = _text_scan(spark, path, RAW_PURCHASES, sep, multi_line, mode)
    rows = _missing_to_null(scan, null_texts)
    return rows.withColumn(
        "transaction_date",
        parse_timestamp(F.col("transaction_date"), date_pattern, strict_dates),
    )


def read_categories_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    null_texts=NULL_TEXTS,
    multi_line: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    scan = _text_scan(spark, path, CATEGORY_FILE, sep, multi_line, mode)
    rows = _missing_to_null(scan, null_texts)
    return rows.withColumnsRenamed(
        {"famille_intitule": "prod_family", "sous_famille_intitule": "prod_subfamily"}
    )


def read_recommendations_csv(
    spark: SparkSession, path: str, prefix: str = "recommendation_", mode: str = "FAILFAST"
) -> DataFrame:
    """A table of five places per customer; ``prefix`` is that of the place columns."""
    names = ["cont_id", *[f"{prefix}{i}" for i in range(1, 6)]]
    schema = StructType([StructField(n, StringType()) for n in names])
    return _text_scan(spark, path, schema, ",", False, mode)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    """One header per part file, doubled quotes, blanks kept (an empty slot is a single blank)."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def export_dated_csv(df: DataFrame, folder: str, day: str | None = None) -> str:
    """Write ``<folder>/<yyyymmdd> file.csv`` and return that path."""
    date = F.lit(day).cast("date") if day else F.current_date()
    stamp = df.sparkSession.range(1).select(file_stamp(date)).first()[0]
    path = f"{folder.rstrip('/')}/{stamp} file.csv"
    write_csv(df, path)
    return path
