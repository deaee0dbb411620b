"""What the operators share: tables written between jobs, and words of a text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from types import TracebackType

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.session import shared_dir

#: Separates words: ASCII blanks only.
BLANKS = "[ \t-\r]+"


class Scratch:
    """Tables between the jobs of one operator, in the folder that all executors share.

    ``keep`` writes a table that goes when the block ends; ``result`` writes one that stays, so that
    what the operator returns does not depend on the tables that went. Reading a written table
    again never repeats the work before it, also after executors are lost.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._root = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self._n = 0

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        return self._written(df, f"{self._root}/{self._n}")

    def result(self, df: DataFrame) -> DataFrame:
        return self._written(df, f"{self._root}-result")

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(
        self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None
    ) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._root)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, in any case of letters, made from the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def words(text: Column) -> Column:
    """The words of a text between ASCII blanks; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other characters unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_remainder(key: Column, n: int) -> Column:
    """crc32 of a key's text modulo ``n``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(n))


def fields(df: DataFrame, column: str, *more: tuple[str, T.DataType]) -> T.StructType:
    """A schema of one column of ``df`` as it is and of new columns."""
    own = T.StructField(column, df.schema[column].dataType)
    return T.StructType([own, *(T.StructField(name, kind) for name, kind in more)])


def runs(batch: pa.RecordBatch, column: str, max_chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have about ``max_chars`` characters, or of one longer text."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    begin = chars = 0
    for i, n in enumerate([*sizes, max_chars + 1]):  # the last ends the last run
        if i > begin and chars + n > max_chars:
            yield batch.slice(begin, i - begin)
            begin, chars = i, 0
        chars += n


def slices(batch: pa.RecordBatch, column: str, max_chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The same with each run's texts; no others are Python's texts at once."""
    for part in runs(batch, column, max_chars):
        yield part, part.column(column).to_pylist()
