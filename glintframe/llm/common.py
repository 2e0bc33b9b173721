"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.sources.tables import shared_folder

#: Words are maximal runs of anything but these bytes: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: What stands between plain words, once A-Z are lower-cased: all of ASCII but 0-9 and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of an Arrow batch of texts in the registered queries.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: df's rows as a table in the shared folder, computed once. It stays until it is discarded."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empties written tables that nothing reads any more."""
    for t in tables:
        t.sparkSession.range(0).write.mode("overwrite").parquet(t.written_to)


def plain_words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of letters, digits and anything beyond ASCII; null without any."""
    found = F.filter(F.split(F.translate(text.cast("string"), UPPER, LOWER), BETWEEN), lambda w: w != "")
    return F.when(F.size(found) > 0, found)


def extent(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows, and bytes of a text column."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(column).cast("string")).cast("long")), F.lit(0))).first()
    return n, size


def pieces(spark: SparkSession, size: int, bytes_each: int) -> int:
    """Shuffle partitions so that each stands for bytes_each of `size` bytes; the session's number at least, 32,768 at most."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // bytes_each), 32_768))


def prepared(spark: SparkSession) -> None:
    """Session settings of the registered queries; operators themselves set none.

    Arrow batches are bounded by bytes, as batches that count rows grow with the texts. Shuffle
    files go when the query that made them has ended.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def give_back() -> None:
    """Hands memory that this process has freed back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, which gives its memory back at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hashed_share(key: Column, seed: str, share: Column | float) -> Column:
    """True for about `share` of the keys, the same ones each time."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < F.lit(1 << 30) * share


def schema_with(df: DataFrame, **more: T.DataType) -> T.StructType:
    """df's schema and further nullable columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in more.items())])


def text_column(batch: pa.RecordBatch, name: str) -> pa.StringArray:
    column = batch.column(batch.schema.get_field_index(name))
    return column if pa.types.is_string(column.type) else column.cast(pa.string())
