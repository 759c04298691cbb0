"""Suggestions arriving as files, recorded as they come.

The same rule as one form submission: each batch of requests becomes purchase rows. A batch is
written under its query's id and its own number with overwrite, so a batch that is run again after a failure replaces
itself and no suggestion is recorded twice, while two queries, or one with a new checkpoint, never meet.
"""

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketry.operators.feedback import long_requests, product_lookup, suggestion_rows
from basketry.schemas import FEEDBACK_REQUESTS, PURCHASES
from basketry.sources.tables import shaped
from basketry.storage import save, scope


def request_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Request files (CSV with header: client_id, suggestion1..3, in any order) as a stream.

    The order of the columns is that of the files that are there; a file with another header is an error, not
    a mix-up. An empty folder stands for the usual order.
    """
    try:
        names = spark.read.option("header", True).csv(folder).columns
    except Exception:  # no file yet
        names = []
    known = {f.name: f for f in FEEDBACK_REQUESTS.fields}
    unknown = set(names) - set(known)
    if unknown:
        raise ValueError(f"unknown columns in {folder}: {sorted(unknown)}")
    schema = StructType([known[n] for n in names]) if names else FEEDBACK_REQUESTS
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in FEEDBACK_REQUESTS if f.name not in schema.names]
    read = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("maxFilesPerTrigger", max_files)
        .csv(folder)
    )
    return read.select("*", *missing).select(*FEEDBACK_REQUESTS.names)


def record_suggestions(
    requests: DataFrame,
    purchases: DataFrame,
    target: str,
    checkpoint: str,
    now: str | Callable[[int], str] | None = None,
):
    """Start a query that records every available request and then stops.

    The products are worked out once, from the purchase log or a product table. ``target`` is the
    suggestions folder of a data set; a batch is a folder there, as an appended set of rows is. ``now`` is the time to
    record: one for all, one for each batch number, or, by default, that at which a batch is recorded.
    """
    products = save(product_lookup(purchases), "products")
    started, query = threading.Event(), []

    def record(batch: DataFrame, number: int) -> None:
        # The id is kept in the checkpoint: the same after a restart, another with a new checkpoint.
        started.wait()
        at = now(number) if callable(now) else now
        with scope(batch.sparkSession):
            rows = suggestion_rows(long_requests(batch), products, F.current_timestamp() if at is None else at)
            folder = f"{target}/stream-{query[0].id}-{number}"
            shaped(rows, PURCHASES).write.mode("overwrite").parquet(folder)

    query.append(
        requests.writeStream.foreachBatch(record)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    started.set()
    return query[0]
