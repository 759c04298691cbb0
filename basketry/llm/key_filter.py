"""A Bloom filter of fixed size over 64-bit keys, to leave out rows before a shuffle.

A filter lets every wanted row through and some others, more of them the more keys there are; the join that
follows decides. Its size does not depend on the data: ``BITS`` bits, 4 MB, worked out in parallel and brought
to the driver as at most BITS / 64 numbers.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 1 << 25


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """The filter over a column of longs; nulls are left out."""
    places = F.explode(
        F.array(F.pmod(F.col(key), F.lit(BITS)), F.pmod(F.shiftright(key, 32), F.lit(BITS)))
    )
    cells = (
        keys.filter(F.col(key).isNotNull())
        .select(places.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return out.view(np.uint64)


def passes(cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be among those of the filter."""
    out = np.ones(len(keys), dtype=bool)
    for place in (keys % BITS, (keys >> 32) % BITS):
        out &= (cells[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def passing(rows: DataFrame, key: str, cells: np.ndarray) -> DataFrame:
    """The rows whose key, a long without nulls, may be among those of the filter."""
    place, sent = rows.columns.index(key), rows.sparkSession.sparkContext.broadcast(cells)

    def of_batches(batches):
        for batch in batches:
            keys = batch.column(place).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(passes(sent.value, keys)))

    return rows.mapInArrow(of_batches, rows.schema)


def marking(rows: DataFrame, key: str, cells: np.ndarray, name: str) -> DataFrame:
    """All rows, with a boolean column: whether the key may be among those of the filter."""
    place, sent = rows.columns.index(key), rows.sparkSession.sparkContext.broadcast(cells)

    def of_batches(batches):
        for batch in batches:
            keys = batch.column(place).to_numpy(zero_copy_only=False)
            maybe = pa.array(passes(sent.value, keys))
            yield pa.RecordBatch.from_arrays([*batch.columns, maybe], names=[*batch.schema.names, name])

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BooleanType())])
    return rows.mapInArrow(of_batches, schema)
