"""Preflight of a harvest: what a manifest says of files against the files, entry by entry and coordinate by coordinate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.ranges import check_ranges

#: Fields that all entries of one file must share.
AGREE = ("source_url", "sha256", "n_bytes")


def preflight(entries: DataFrame, chunks: DataFrame, agree: tuple[str, ...] = AGREE, near: int = 0) -> DataFrame:
    """One row for each file: path, entries, chunks, verified_bytes, failures.

    entries (path, sha256, n_bytes, section_label, rendered_label, capture_sha256, further fields of `agree`) may name a file several times, if they
    agree; chunks (path, start, length, sha256) must select their bytes. Failures, in this order:
    fields (entries differ in a field of `agree`), captures (two digests of what was captured), label (of several entries none has the label
    that the file itself gives), bytes (the file isn't as long as said), digest, no_file, no_entry (only chunks name it), chunk_shifted,
    chunk_changed, chunk_beyond, chunk_invalid. Null paths are one file that isn't there; a null field is a value of its own.
    """
    differ = [F.countDistinct(F.struct(F.col(c))) > 1 for c in agree]
    labelled = F.max(F.coalesce(F.col("section_label") == F.col("rendered_label"), F.lit(False)).cast("int"))
    group = entries.groupBy("path").agg(
        F.count(F.lit(1)).alias("entries"), F.max("sha256").alias("sha256"), F.max("n_bytes").cast("long").alias("n_bytes"),
        F.greatest(F.lit(False), *differ).alias("_fields"), (F.countDistinct("capture_sha256") > 1).alias("_captures"), (labelled == 0).alias("_label"),
    )
    # A file is a range from 0 to its end; with the length that the entries state, a longer file would pass.
    whole = group.select("path", F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("length"), "sha256", F.lit(True).alias("whole"))
    end = group.select("path", F.greatest("n_bytes", F.lit(0)).alias("start"), F.lit(None).cast("long").alias("length"), F.sha2(F.lit(""), 256).alias("sha256"), F.lit(None).cast("boolean").alias("whole"))
    part = chunks.select("path", F.col("start").cast("long"), F.col("length").cast("long"), "sha256", F.lit(False).alias("whole"))
    looked = check_ranges(whole.unionByName(end).unionByName(part), near)
    is_whole, is_end, is_part = F.col("whole"), F.col("whole").isNull(), ~F.col("whole")
    seen = looked.groupBy("path").agg(
        F.max(F.when(is_whole, F.col("status"))).alias("_file"), F.max(F.when(is_end, F.col("status"))).alias("_end"),
        F.count(F.when(is_part, 1)).alias("chunks"), F.collect_set(F.when(is_part, F.col("status"))).alias("_parts"),
    )
    out = seen.join(group.withColumnRenamed("path", "_path"), F.col("path").eqNullSafe(F.col("_path")), "left")
    there = F.col("_file").isin("ok", "changed", "shifted")
    sized = there & (F.col("_end") == "ok") & F.col("n_bytes").isNotNull() & (F.col("n_bytes") >= 0)
    checks = [
        ("fields", F.col("_fields")), ("captures", F.col("_captures")), ("label", F.col("_label") & (F.col("entries") > 1)), ("bytes", there & ~sized),
        ("digest", there & ((F.col("_file") != "ok") | F.col("sha256").isNull())), ("no_file", (F.col("_file") == "no_file") | (F.col("_file").isNull() & F.array_contains("_parts", "no_file"))),
        ("no_entry", F.col("entries").isNull()), *((f"chunk_{s}", F.array_contains("_parts", s)) for s in ("shifted", "changed", "beyond", "invalid")),
    ]
    failures = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))
    return out.select("path", F.coalesce("entries", F.lit(0).cast("long")).alias("entries"), "chunks", F.when(sized, F.col("n_bytes")).alias("verified_bytes"), failures.alias("failures"))


def preflight_proof(files: DataFrame) -> DataFrame:
    """One row over preflight's: entries, files, files_verified, bytes_verified, repeated_files, chunks, passed."""
    good = F.size("failures") == 0
    return files.agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.count(F.lit(1)).alias("files"), F.count(F.when(good, 1)).alias("files_verified"),
        F.coalesce(F.sum(F.when(good, F.col("verified_bytes"))), F.lit(0)).alias("bytes_verified"), F.count(F.when(F.col("entries") > 1, 1)).alias("repeated_files"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.every(good), F.lit(True)).alias("passed"),
    )
