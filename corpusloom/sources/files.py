"""Raw files of uploads: written by tasks, read as bytes in a batch or as a stream of what arrives."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash, decode_text, trim_all
from corpusloom.sources.shared import materialise, small_batches

#: What binaryFile gives; a stream of files must be told.
BINARY = "path string, modificationTime timestamp, length bigint, content binary"
#: Extensions whose files are text.
TEXTS = (".txt", ".md")


def write_files(files: DataFrame, path: str) -> DataFrame:
    """Write each row of files (name, content binary; null content is an empty file) as a file of that
    name under path, in one of 256 folders by the name's hash, and return what was written (name, size).

    Names must differ, and stay within their folder: one with a slash is an error.  A file gets its name when
    it is whole, so that a task tried again replaces it.  path: a local one that all nodes see, or a URI known to pyarrow."""
    small_batches(files.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")
        made = set()
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                if not name or "/" in name:
                    raise ValueError(f"not a file's name: {name!r}")
                folder = f"{base}/{hashlib.sha1(name.encode()).hexdigest()[:2]}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                # readers skip names that start with a dot
                with store.open_output_stream(f"{folder}/.{name}.part") as out:
                    out.write(content or b"")
                store.move(f"{folder}/.{name}.part", f"{folder}/{name}")
                sizes.append(len(content or b""))
            yield pa.record_batch([batch.column("name").cast(pa.string()), pa.array(sizes, pa.int64())], names=["name", "size"])

    return materialise(files.select("name", "content").mapInArrow(put, "name string, size long"), "files")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, id, extension, size, content, hash of raw files named id + extension, at any depth, whose names match glob.

    Spark's file sources pass over files without bytes: those are in the sink's log alone, see empty_files."""
    return _named(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path))


def stream_files(spark: SparkSession, path: str, glob: str = "*", at_once: int = 10_000) -> DataFrame:
    """read_files as a stream: each file once, at most at_once files in a micro-batch, none without bytes."""
    read = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return _named(read.option("maxFilesPerTrigger", at_once).load(path))


def empty_files(written: DataFrame) -> DataFrame:
    """The files without bytes among what write_files has written (name, size), as read_files would give them; path is the name."""
    return _named(written.where("size = 0").select(F.col("name").alias("path"), F.col("size").alias("length"), F.lit(b"").alias("content")))


def _named(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("id"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("extension"), F.col("length").alias("size"), "content", content_hash(F.col("content")).alias("hash"))


def texts_of(files: DataFrame) -> DataFrame:
    """id, extension, size, hash, text of files: bytes as UTF-8, invalid ones as U+FFFD, trimmed; null where
    the extension isn't one of TEXTS (in any case)."""
    text = F.when(F.lower("extension").isin(*TEXTS), trim_all(decode_text(F.col("content"))))
    return files.select("id", "extension", "size", "hash", text.alias("text"))


def start_extract(files: DataFrame, out: str, checkpoint: str):
    """Write texts_of a stream of files to out (availableNow): each file once, also after a restart."""
    return texts_of(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
