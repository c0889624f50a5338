"""Readers: files of text, records, manifests, pages and objects as DataFrames with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brindle.functions import text as tx
from brindle.lineage import cut
from brindle.operators.filters import blocked_page


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown_folder(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, title, text) of all files below root (S2): the title is the first heading, else the file's stem."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(root, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return rows.withColumn("title", F.coalesce(F.nullif(F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1)), F.lit("")), stem))


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Objects a line; a line that isn't one fails the read (S3)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def variant_lines(spark: SparkSession, path: str) -> DataFrame:
    """(record variant) of JSON lines whose shape differs, routed by `lifecycle.classify_record`."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("record"))


def csv_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A header CSV with trimmed cells, with or without a byte order mark."""
    df = spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", enforceSchema=True)
    return df.select(*[F.trim(c).alias(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c) for c in df.columns])


def url_manifest(rows: DataFrame, root: str, url: str = "url", line: str = "line") -> DataFrame:
    """Rows with a canonical url under root, the first of each by line."""
    out = rows.withColumn("canonical_url", tx.canonical_url(F.col(url), root)).where("canonical_url is not null")
    w = Window.partitionBy("canonical_url").orderBy(line)
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def captures(manifest: DataFrame, bodies: DataFrame, url: str = "url", html: str = "html", path: str = "path") -> DataFrame:
    """Captured pages with their body, inline or by file, and an error instead of a failure."""
    out = manifest.join(bodies.select(path, F.col("text").alias("_file")), path, "left").withColumn("body", F.coalesce(html, "_file"))
    error = F.when(F.col("body").isNull(), "no body").when(blocked_page(F.col("body")), "blocked page").when(F.col(url).isNull(), "no url")
    return out.withColumn("error", error).drop("_file")


def crawl(seeds: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
    """(url, depth): what is reached over saved pages' links (source, target) from the seeds, breadth first."""
    front = seen = cut(seeds.select("url", F.lit(0).alias("depth")).distinct())
    for d in range(1, rounds + 1):
        step = front.join(links, front["url"] == links["source"]).select(F.col("target").alias("url")).distinct()
        front = cut(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front)) if d % 8 == 0 else seen.unionByName(front)
    return seen


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each anchor: href and its text."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?is)(<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>)'), F.lit(1))
    rows = pages.withColumn("_a", F.explode(found))
    href, label = (F.regexp_extract("_a", p, 1) for p in (r'(?is)href="([^"]*)"', r"(?is)>([^<]*)</a>$"))
    return rows.select(*[c for c in pages.columns if c != html], href.alias("href"), F.trim(label).alias("label"))


def absolute_url(href: Column, base: Column) -> Column:
    """href against its page, without a fragment."""
    home = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([A-Za-z]+://[^?#]*)", 1), r"(?<=[^:/])/[^/]*$", "")
    full = F.when(href.rlike("^[A-Za-z]+://"), href).when(href.startswith("/"), F.concat(home, href)).otherwise(F.concat(folder, F.lit("/"), href))
    return F.regexp_replace(full, "#.*$", "")


def document_links(pages: DataFrame, url: str, host: str, keyword: str, suffix: str = ".pdf") -> DataFrame:
    """Links of pages to documents on one host whose label or address holds a word, each once."""
    links = page_links(pages).withColumn("target", absolute_url(F.col("href"), F.col(url)))
    ok = F.lower("target").endswith(suffix) & F.lower("target").rlike(rf"^[a-z]+://([^/]*\.)?{host}(/|$)")
    return links.where(ok & F.contains(F.lower(F.concat_ws(" ", "label", "target")), F.lit(keyword))).dropDuplicates(["target"])


def objects(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, sha256) of files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return df.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def custody_objects(files: DataFrame, records: DataFrame, max_bytes: int) -> DataFrame:
    """Files that a record declares, bounded in size and with the declared digest."""
    return files.where(F.col("length") <= max_bytes).join(records.select("sha256", "record_id"), "sha256")


def decode_upload(content: Column) -> Column:
    """Bytes as text: by byte order mark, by the zeros of UTF-16, else UTF-8."""
    head, hexed = F.hex(F.substring(content, 1, 2)), F.hex(F.substring(content, 1, 64))
    utf8 = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.expr("cast(null as binary)")).otherwise(content)
    bare = F.coalesce(utf8, F.substring(content, F.lit(4), F.octet_length(content)))
    low = F.when(F.length(hexed) >= 4, hexed.rlike("^([0-9A-F]{2}00)+$"))
    high = F.when(F.length(hexed) >= 4, hexed.rlike("^(00[0-9A-F]{2})+$"))
    after = F.substring(content, F.lit(3), F.octet_length(content))
    return (
        F.when(head == "FFFE", F.decode(after, "UTF-16LE")).when(head == "FEFF", F.decode(after, "UTF-16BE"))
        .when(low, F.decode(content, "UTF-16LE")).when(high, F.decode(content, "UTF-16BE")).otherwise(F.decode(bare, "UTF-8"))
    )


def settings(spark: SparkSession, rows: dict[str, dict]) -> DataFrame:
    """Configuration as a table (id, value variant)."""
    import json

    return spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], "id string, value string").select("id", F.parse_json("value").alias("value"))
