"""What several operators of this subpackage share."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed pattern of the contracts: a word is a run of anything but these six ASCII white-space characters.
# bytes.split() without arguments cuts at exactly the same characters.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_LIMIT = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes besides rows, so a run of very long texts does not fill a worker.

    A session that names its own limit keeps it.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, BATCH_LIMIT)


def in_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Map Arrow batches of bounded bytes; `fn` gives a dict of output columns for one batch."""
    spark = df.sparkSession
    bounded_batches(spark)
    target = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes, null as empty."""
    return [b"" if t is None else t for t in batch.column(name).cast(pa.binary()).to_pylist()]


def word_count(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(t, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def unit_draw(*parts: Column) -> Column:
    """A stable draw in (0, 1) from the MD5 of the parts' text, the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
