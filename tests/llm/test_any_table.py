"""Every operator and stage on tables with clashing column names, without rows, and with a very long text."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import chat_format, decontaminate, html_extract, line_frequency, mixing, near_dup, rule_classifier, sharding, token_count, url_filter

CLASHING = "s_url _i _y _id _key _copy _row _text _gone _hit _made _main _digest _host _n _b _r _g score n_words items hit_words removed id g s h d p q t at base spans lines key host path rule shard slot size n_tokens".split()
MODEL = "piece_bpe_32k.model"


def operators(spark, sf):
    table = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    model = rule_classifier.train(table("documents"), table("labels"))
    bench = table("benchmark")
    rules = [url_filter.Rule("block", "org", "/")]
    keys = spark.createDataFrame([("example.net",)], "key string")
    return {
        "op1": ("documents", lambda d: decontaminate.decontaminate(d, bench, ["doc_id"])),
        "op1 in blocks": ("documents", lambda d: decontaminate.keep_clean(d, bench, block_bytes=4000)),
        "op2": ("documents", mixing.mix),
        "op3": ("documents", lambda d: token_count.count_tokens(d, MODEL, 4096)),
        "op4": ("documents", sharding.assign_shards),
        "op5": ("pages", html_extract.extract_pages),
        "op6": ("documents", line_frequency.apply_rules),
        "op6 lines": ("documents", line_frequency.remove_lines),
        "op7": ("documents", lambda d: near_dup.near_duplicates(d, shingle=3, percent=85)),
        "op8": ("pages", lambda p: url_filter.judge(p, rules, keys)),
        "op9": ("conversations", lambda c: chat_format.digests(chat_format.format_conversations(chat_format.as_events(c)))),
        "op10": ("documents", lambda d: rule_classifier.classify(d, model, ["doc_id"])),
        **{name: ("documents", lambda d, stage=stage: stage(spark, d, sf)) for name, stage in corpus_pipeline.STAGES},
    }


NAMES = ["op1", "op1 in blocks", "op2", "op3", "op4", "op5", "op6", "op6 lines", "op7", "op8", "op9", "op10", *(n for n, _ in corpus_pipeline.STAGES)]


@pytest.mark.parametrize("name", NAMES)
def test_clashing_names_empty_tables_and_long_texts(spark, sf, name):
    source, run = operators(spark, sf)[name]
    table = spark.read.parquet(f"{sf}/{source}.parquet")
    body = "html" if source == "pages" else "text"
    key = table.columns[0]
    if name == "quality classifier":
        plain = run(table)
    else:
        table = table.limit(60).cache()
        plain = run(table)
    more = [c for c in CLASHING if c not in (x.lower() for x in table.columns)]
    wide = table.select("*", *[F.concat(F.lit(f"{c} of "), F.col(key).cast("string")).alias(c) for c in more])
    got = run(wide)
    same = [c for c in plain.columns if c not in more or c in ("n_words", "items", "hit_words", "size", "shard", "slot", "n_tokens", "score", "host", "path", "rule") and c in plain.columns]
    rows = lambda df: Counter(str(tuple(r)) for r in df.select(*[F.col(f"`{c}`") for c in same]).collect())
    assert rows(got) == rows(plain)
    stages = dict(corpus_pipeline.STAGES)
    if name in stages or name in ("op1 in blocks", "op6 lines"):  # other columns pass, with each row's own values
        kept = [c for c in more if not (name == "sharding" and c in ("shard", "slot"))]
        assert set(wide.columns) <= set(got.columns)
        assert got.where(" or ".join(f"not (`{c}` <=> concat('{c} of ', cast(`{key}` as string)))" for c in kept)).count() == 0
    empty = run(wide.limit(0))
    assert empty.count() == 0 and empty.columns == got.columns
    long = table.limit(3).withColumn(body, F.when(F.col(key) == table.first()[0], F.concat(F.lit("<p>"), F.repeat(F.lit("long text of many words, "), 45_000))).otherwise(F.col(body)))
    assert run(long).count() <= 6
