"""Old log partitions copied to an archive, by a manifest (SNK-7). Sources stay; removing them is the operator's."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.sources.logs import old_files

MANIFEST = "file string, length long, sha256 string, target string"
_PIECE = 1 << 20


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _digest(uri: str) -> tuple[str, int]:
    store, path = _open(uri)
    found, size = hashlib.sha256(), 0
    with store.open_input_stream(path, compression=None) as stream:
        while piece := stream.read(_PIECE):
            found.update(piece)
            size += len(piece)
    return found.hexdigest(), size


def _copy(source: str, target: str) -> tuple[str, int]:
    """The file at its target, under its last name only when it is whole; digest and size of what was read."""
    store, path = _open(source)
    there, to = _open(target)
    there.create_dir(to.rpartition("/")[0], recursive=True)
    draft, found, size = f"{to}.{uuid4().hex}.part", hashlib.sha256(), 0
    with store.open_input_stream(path, compression=None) as stream, there.open_output_stream(draft, compression=None) as out:
        while piece := stream.read(_PIECE):
            out.write(piece)
            found.update(piece)
            size += len(piece)
    there.move(draft, to)
    return found.hexdigest(), size


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """What an archive holds: one row per file, with its digest."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{target}/_manifest").dropDuplicates(["file", "sha256"])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def copy(spark: SparkSession, path: str, target: str, cutoff: str) -> DataFrame:
    """Copies the files of partitions older than the cutoff, keeping their folders, and returns this run's manifest rows.

    Every copy is read again and held against what was read from the source; one that differs ends the job. Rows enter
    the manifest when all their copies are whole, so a job that is run again after a failure copies what isn't there
    yet: files that the manifest has with the same size are left out.
    """
    files = old_files(spark, path, cutoff).select(F.col("source_file").alias("file"), "length")
    root = path.rstrip("/").removeprefix("file://").removeprefix("file:")
    rest = F.regexp_replace(F.col("file"), r"^file:/*", "/")
    todo = files.join(manifest(spark, target).select("file", "length").distinct(), ["file", "length"], "left_anti")
    todo = todo.withColumn("target", F.concat(F.lit(target.rstrip("/")), F.when(rest.startswith(root), F.substring(rest, F.lit(len(root) + 1), F.length(rest))).otherwise(F.concat(F.lit("/"), F.regexp_replace(rest, "^.*?://", "")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                digest, size = _copy(row["file"], row["target"])
                if (digest, size) != _digest(row["target"]) or size != row["length"]:
                    raise OSError(f"the copy of {row['file']} is not what was read")
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "length": size, "sha256": digest, "target": row["target"]}], pa.schema([("file", pa.string()), ("length", pa.int64()), ("sha256", pa.string()), ("target", pa.string())]))

    job = uuid4().hex
    dealt = todo.repartition(spark.sparkContext.defaultParallelism, "file")  # few bytes a row; the work is in the files
    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{target}/_jobs/{job}")
    done = spark.read.schema(MANIFEST).parquet(f"{target}/_jobs/{job}")
    done.write.mode("append").parquet(f"{target}/_manifest")
    return done


def verified(spark: SparkSession, target: str) -> DataFrame:
    """The manifest with ``whole``: whether each copy still has its size and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    ok = _digest(row["target"]) == (row["sha256"], row["length"])
                except OSError:
                    ok = False
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "whole"])

    return manifest(spark, target).repartition("file").mapInArrow(run, f"{MANIFEST}, whole boolean")
