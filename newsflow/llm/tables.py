"""Reading the tables and small shared steps of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.lineage import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *pairs: tuple[str, str, str]) -> DataFrame:
    """The named columns alone, as (input name, output name, type); other columns never clash with ours."""
    return df.select(*[F.col(f"`{a}`").cast(t).alias(b) for a, b, t in pairs])


def text_key(text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) * 2 + F.when(text.isNull(), 1).otherwise(0)


def record(columns: Sequence[tuple[str, pa.DataType, object]]) -> pa.RecordBatch:
    """A batch of (name, type, values)."""
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, t) for _, t, v in columns],
        schema=pa.schema([(n, t) for n, t, _ in columns]),
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of this session's own only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        ensure_checkpoint_dir(spark)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


_STORED: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name.replace(' ', '_')}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Removes what ``stored`` wrote for these, once nothing that is still to be computed reads it."""
    for df in frames:
        _remove(df.sparkSession, df.stored_at)


def discard(spark: SparkSession, kept: DataFrame) -> None:
    """Removes all that ``stored`` wrote in this process and ``kept`` doesn't read."""
    read_by = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in kept.inputFiles()}
    for path in list(_STORED):
        if path.rsplit("/", 1)[-1] not in read_by:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _STORED:
        _STORED.remove(path)
