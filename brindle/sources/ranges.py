"""Byte ranges of files: texts packed into few files with their coordinates, and a reader that takes only the bytes a table asks for.

Coordinates are (path, start, length), in bytes. Tasks of the reader take a stretch of a file each, in order of `start`, and read pieces of
at most `PIECE` bytes, so neither a large file, nor a long range, nor very many ranges of one file is ever in memory, or in one task.
Paths are those that Spark gives, of local or shared folders and of the stores that Arrow's file systems open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIECE = 1 << 20
#: Bytes of a file whose ranges one task reads, and bytes of texts to a packed file.
STRETCH, PACK = 8 << 20, 128 << 20


def pack(df: DataFrame, key: str, text: str, at: str, file_bytes: int = PACK) -> DataFrame:
    """(key, path, start, length, sha256) of df's texts, which are written to files below `at`, a line feed after each.

    Null is the empty text. Files are buckets of a hash of key and digest, as many as the bytes need; a row's bucket and its place follow from
    its key and text alone, equal rows lie side by side, so a second reading of df or a lost executor changes no coordinate.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), body.alias("value"), F.sha2(body, 256).alias("sha256"))
    total = rows.agg(F.sum(F.octet_length("value") + F.lit(1).cast("long"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "sha256"), F.lit(files)).cast("int"))
    order = [F.col("bucket"), F.col("key").asc_nulls_first(), F.col("sha256")]
    rows.repartitionById(files, "bucket").sortWithinPartitions(*order).select("bucket", "value").write.partitionBy("bucket").text(at)
    written = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(at)
    written = written.select("path", F.regexp_extract("path", r"/bucket=(\d+)/", 1).cast("int").alias("bucket"))
    before = Window.partitionBy("bucket").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)  # one file's coordinates
    n = F.octet_length("value").cast("long")
    places = rows.select("key", "sha256", "bucket", n.alias("length"))
    places = places.withColumn("start", F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0).cast("long")))
    return places.join(written, "bucket").select(F.col("key").alias(key), "path", "start", "length", "sha256")


def _opened(path: str):
    """(file, size) of a path as Spark writes it."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        file = system.open_input_file(inner)
        return file, file.size()
    from os.path import getsize

    local = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    return open(local, "rb"), getsize(local)


def _digest(file, start: int, length: int) -> str:
    file.seek(start)
    h, left = hashlib.sha256(), length
    while left and (piece := file.read(min(PIECE, left))):
        h.update(piece)
        left -= len(piece)
    return h.hexdigest()


def _status(file, size: int, start, length, sha256, near: int) -> tuple[str, str | None, int | None]:
    """(status, digest found, shift): a shift is the smallest move within `near` bytes, back before forth, that gives the declared digest."""
    if start is None or start < 0 or (length is not None and length < 0):
        return "invalid", None, None
    length = max(0, size - start) if length is None else length
    found = _digest(file, start, length) if start + length <= size else None
    if found is not None and (sha256 is None or found == sha256):
        return "ok", found, 0
    for d in (s * k for k in range(1, near + 1) for s in (-1, 1)):
        if 0 <= start + d and start + d + length <= size and _digest(file, start + d, length) == sha256:
            return "shifted", found, d
    return ("beyond", None, None) if found is None else ("changed", found, None)


def check_ranges(ranges: DataFrame, near: int = 0, stretch: int = STRETCH) -> DataFrame:
    """ranges (path, start, length, sha256 and what else they have) with status, found_sha256 and shift.

    Status: ok; shifted (the bytes lie `shift` bytes further, at most `near` either way); changed; beyond (the file ends before); no_file (also a
    null path); invalid (a null or negative start, a negative length). A null length goes up to the end of the file, a null digest asks for
    nothing but the range to be there. An empty range is ok wherever it lies inside the file. Only ranges that don't hold are looked for
    again, twice `near` times.
    """
    names = ranges.columns
    if clash := {"status", "found_sha256", "shift", "_stretch"} & set(names):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    schema = ranges.select(*names, F.lit("").alias("status"), F.lit("").alias("found_sha256"), F.lit(0).cast("long").alias("shift")).schema
    schema = schema.fromJson({"type": "struct", "fields": [{**f, "nullable": True} for f in schema.jsonValue()["fields"]]})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, size = None, None, 0
        try:
            for b in batches:
                out = []
                asked = (b.column(names.index(c)).to_pylist() for c in ("path", "start", "length", "sha256"))
                for p, start, length, sha256 in zip(*asked):
                    if p != path:
                        if file is not None:
                            file.close()
                        path, file = p, None
                        try:
                            file, size = _opened(p) if p is not None else (None, 0)
                        except FileNotFoundError:
                            file = None
                    out.append(("no_file", None, None) if file is None else _status(file, size, start, length, sha256, near))
                new = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*names, "status", "found_sha256", "shift"])
        finally:
            if file is not None:
                file.close()

    rows = ranges.withColumn("_stretch", F.floor(F.coalesce("start", F.lit(0)) / stretch))
    rows = rows.repartition("path", "_stretch").sortWithinPartitions("path", "start").drop("_stretch")
    return rows.mapInArrow(read, schema)
