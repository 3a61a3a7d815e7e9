"""What the corpus operators share: reading tables, row identity, walking Arrow batches.

Row identity: a document is its (doc_id, hash of its text).  Rows that agree in both are copies of
one row and get the same answer; rows that share only the doc_id, or have none, stay apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder

#: texts handled at once inside a task, so that work space does not depend on the Arrow batch
TEXTS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash() -> Column:
    """Second half of a document's identity; a null text hashes like no other."""
    return F.xxhash64(F.col("text"), F.col("text").isNull())


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and text of docs, whatever other columns there are."""
    return docs.select("doc_id", text_hash().alias("text_hash"), "text")


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, with a known size, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written(), after everything that reads it is computed."""
    folders = {path.rsplit("/", 1)[0] for path in df.inputFiles()}
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: bits of a table of keys, 8 MB
TABLE_BITS = 1 << 26


def bit_table(keys: DataFrame) -> np.ndarray:
    """Which of TABLE_BITS bits the 64-bit numbers in the one column of keys stand for: of fixed size, however many they are."""
    key = F.col(keys.columns[0])
    low, high = key.bitwiseAND(F.lit(TABLE_BITS - 1)), F.shiftrightunsigned(key, 38)
    bits = keys.select(F.explode(F.array(low, high)).alias("bit"))
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(F.lit(63)).cast("int")))
    found = bits.groupBy(F.shiftright("bit", 6).alias("slot")).agg(mask.alias("mask")).toArrow()
    table = np.zeros(TABLE_BITS // 64, dtype=np.uint64)
    table[found.column("slot").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return table


def in_bit_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of those the table was made of; it always is if it is."""
    keys = keys.view(np.uint64)
    found = np.ones(len(keys), dtype=bool)
    for bit in (keys & np.uint64(TABLE_BITS - 1), keys >> np.uint64(38)):
        found &= (table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def pieces(batches: Iterator[pa.RecordBatch], rows: int = TEXTS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first variation of it that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    return batch.set_column(at, pa.field(name, values.type), values)
