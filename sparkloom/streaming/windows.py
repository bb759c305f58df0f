"""Event-time windows that work on batch tables and on streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.formula import quoted


def windowed(df: DataFrame, ts: str, aggregates: list[Column], size: str, slide: str | None = None, keys: list[str] | None = None, late: str | None = None, session: bool = False) -> DataFrame:
    """Tumbling, sliding or session windows; ``late`` is the watermark of a stream."""
    source = df.withWatermark(ts, late) if late and df.isStreaming else df
    t = F.col(quoted(ts)).cast("timestamp")
    w = F.session_window(t, size) if session else F.window(t, size, slide) if slide else F.window(t, size)
    out = source.groupBy(w.alias("w"), *[F.col(quoted(k)) for k in keys or []]).agg(*aggregates)
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *[c for c in out.columns if c != "w"])


def deduplicated(df: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """One row per key; on a stream within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order``; ties go to the greatest row."""
    row = F.struct(*[F.col(quoted(c)) for c in (order, *[c for c in df.columns if c != order])])
    return df.groupBy(*[F.col(quoted(k)).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max(row).alias("_r")).select(*[F.col(f"_r.{quoted(c)}").alias(c) for c in df.columns])


def upsert_stream(df: DataFrame, path: str, keys: list[str], checkpoint: str, order: str):
    """A streaming query that keeps the row of each key with the greatest ``order`` in a Parquet table.

    Versions are written beside each other and named in ``_current``; the version before the last is
    removed, so that a reader of the last one is not disturbed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new, last = latest(batch, keys, order), None
        try:
            last = spark.read.text(f"{path}/_current").first()[0]
            if last == f"v{number}":
                return  # this batch is already there
            new = latest(spark.read.parquet(f"{path}/{last}").unionByName(new, allowMissingColumns=True), keys, order)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{path}/v{number}")
        spark.createDataFrame([(f"v{number}",)], "v string").coalesce(1).write.mode("overwrite").text(f"{path}/_current")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def current(spark, path: str) -> DataFrame:
    """The table that ``upsert_stream`` keeps, as of its last batch."""
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/_current').first()[0]}")
