"""Sources and sinks by connection type."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.errors import UnsupportedError, ValidationError

FILES = {"csv", "parquet", "json", "orc", "text", "xml", "avro"}
#: Connection type -> reader format, and whether a connector jar is needed.
CONNECTIONS: dict[str, tuple[str, bool]] = {
    "filesystem": ("file", False), "hdfs": ("file", False), "managedfolder": ("file", False), "s3": ("file", True), "gcs": ("file", True), "azure": ("file", True),
    "postgresql": ("jdbc", True), "mysql": ("jdbc", True), "redshift": ("jdbc", True), "bigquery": ("bigquery", True), "snowflake": ("snowflake", True), "mongodb": ("mongodb", True), "elasticsearch": ("org.elasticsearch.spark.sql", True),
}
DEFAULTS: dict[str, dict[str, str]] = {"csv": {"header": "true", "mode": "PERMISSIVE", "escape": '"', "encoding": "UTF-8"}, "parquet": {}, "json": {}}


def read(spark: SparkSession, spec: dict[str, Any]) -> DataFrame:
    """Read ``{connection?, format?, path?, options?, schema?, columns?}``."""
    kind = str(spec.get("connection", "filesystem")).lower().replace("_", "")
    if kind not in CONNECTIONS:
        raise UnsupportedError(f"connection {spec.get('connection')!r}")
    how, _ = CONNECTIONS[kind]
    fmt = str(spec.get("format") or ("parquet" if how == "file" else how)).lower()
    if how == "file" and fmt not in FILES:
        raise UnsupportedError(f"format {fmt!r}")
    reader = spark.read.format(fmt).options(**{**DEFAULTS.get(fmt, {}), **{k: str(v) for k, v in (spec.get("options") or {}).items()}})
    if spec.get("schema"):
        reader = reader.schema(spec["schema"])
    try:
        df = reader.load(spec["path"]) if spec.get("path") else reader.load()
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "ClassNotFound" in str(e):
            raise UnsupportedError(f"no connector for {kind}: its jar is missing") from e
        raise
    return df.select(*spec["columns"]) if spec.get("columns") else df


def write(df: DataFrame, spec: dict[str, Any]) -> None:
    """Write to ``{format?, path, mode?, partition_by?, options?}``."""
    fmt = str(spec.get("format", "parquet")).lower()
    if fmt not in FILES and fmt != "jdbc":
        raise UnsupportedError(f"format {fmt!r}")
    if fmt != "jdbc" and not spec.get("path"):
        raise ValidationError("a sink needs a path")
    options = {"parquet": {"compression": "snappy"}, "csv": {"header": "true", "escape": '"'}}.get(fmt, {})
    writer = df.write.format(fmt).mode(spec.get("mode", "overwrite")).options(**{**options, **(spec.get("options") or {})})
    if spec.get("partition_by"):
        writer = writer.partitionBy(*spec["partition_by"])
    writer.save(spec["path"]) if spec.get("path") else writer.save()


def list_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: path, length and time of change, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified_at"))


def sync(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A copy with columns matched by name: listed ones in order, missing ones null."""
    if not columns:
        return df
    return df.select(*[df[c] if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
