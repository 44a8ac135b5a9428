"""Exact dedup against brute force, and its filter."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from spreadloom.llm import exact_dedup
from spreadloom.llm.entries import op13_exact_dedup
from spreadloom.llm.exact_dedup import drop_copies, filter_log2, mark_copies, repeat_filter


def plain(docs):
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in docs]
    groups = defaultdict(list)
    for i, n in norm:
        groups[n].append(i)
    out = []
    for i, n in norm:
        known = [x for x in groups[n] if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


CASES = [
    (1, "a b"), (2, "a  b"), (3, "a\t\r\n b"), (4, "a b "), (5, " a b"), (6, "a b"), (7, "A b"), (8, None), (9, ""),
    (10, " "), (11, "\n\n"), (12, "\x1c"), (13, "x" * 300_000), (14, "x" * 300_000), (15, "x" * 300_000 + "y"),
    (None, "a b"), (None, "only without id"), (None, "only without id"), (20, "twice"), (20, "twice"), (21, "twice"),
    (30, "é\x0b\x0cé"), (31, "é é"), (40, "alone")] + [(100 + i, "hot text") for i in range(300)]


def test_defined_cases(spark):
    df = spark.createDataFrame([(a, b, "s", 1) for a, b in CASES], "doc_id long, text string, kept string, row int")
    got = mark_copies(df.repartition(5))
    assert got.columns == ["doc_id", "text", "kept", "row", "keep_id", "group_size", "kept_1", "text_sha256"]
    assert sorted((tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept_1", "text_sha256").collect()), key=str) == plain(CASES)
    assert sorted(map(str, (tuple(r) for r in got.select("doc_id", "text").collect()))) == sorted(map(str, CASES))
    assert mark_copies(df.limit(0)).count() == 0
    stay = drop_copies(df)
    assert stay.columns == df.columns
    assert stay.count() == sum(kept for *_, kept, _ in plain(CASES))


def test_full_filter_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_LOG2", 0)
    monkeypatch.setattr(exact_dedup, "MOST_WORDS_LOG2", 1)
    df = spark.createDataFrame(CASES, "doc_id long, text string")
    assert sorted((tuple(r) for r in mark_copies(df, carry=["doc_id"]).collect()), key=str) == plain(CASES)


def test_filter_misses_no_repeat_and_suspects_few(spark):
    n = 40_000
    rows = spark.range(n).select(F.xxhash64("id").alias("hash"), F.col("id").alias("i"))
    twice = rows.filter("i < 2000")
    log2 = filter_log2(n)
    shards = repeat_filter(rows.unionByName(twice).select("hash"), log2)
    assert shards.count() == 1 << log2 - exact_dedup.SHARD_LOG2
    assert {len(r.bits) for r in shards.collect()} == {1 << exact_dedup.SHARD_LOG2}
    found = (rows.join(shards, F.shiftrightunsigned("hash", 64 - log2 + exact_dedup.SHARD_LOG2) == F.col("shard"))
             .filter(exact_dedup._possible_repeat(log2)))
    assert found.filter("i < 2000").count() == 2000
    assert found.filter("i >= 2000").count() < 0.01 * n
    assert filter_log2(0) == exact_dedup.SHARD_LOG2 + 1 and filter_log2(10 ** 12) == exact_dedup.MOST_WORDS_LOG2


def test_rows_that_are_alone_do_not_shuffle(spark, sf_dir):
    out = op13_exact_dedup(spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    through = plan[plan.index("Union"):].split("exact-suspects")[0]
    assert "Exchange hashpartitioning" not in through and "BroadcastHashJoin" in through


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op13_exact_dedup(spark, sf_dir).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs)
