"""Hot keys: the two-level operators equal the plain fold, whatever the block size."""

import random
import re

import pytest
from pyspark.sql import functions as F

from symloom.operators import chunks as ch
from symloom.operators import index as ix
from symloom.operators import scale


def random_chunks(seed=5, hot=400):
    """One stream holds most of the chunks."""
    rng = random.Random(seed)
    pieces = ["", "a", "bc ", "\n", "x\ny", "déf", "\n\nz", "end\n"]
    rows = [(0, seq, rng.choice(pieces)) for seq in range(hot)]
    for stream in range(1, 30):
        seqs = sorted(rng.sample(range(100000), rng.randint(1, 8)))
        rows += [(stream, seq, rng.choice(pieces)) for seq in seqs]
    return rows


def literal_cursor(rows, starts, width=len):
    found, at = {}, dict(starts)
    for stream, seq, text in sorted(rows):
        line, column = at.get(stream, (0, 0))
        down, after = text.count("\n"), width(text.rsplit("\n", 1)[-1])
        ends = (line + down, after if down else column + after)
        found[stream, seq] = (line, column, *ends)
        at[stream] = ends
    return found


def literal_progress(rows):
    """Reports as the chunks come, and what stays pending."""
    reports, pending = {}, {}
    for stream, seq, text in sorted(rows):
        if "\n" in text:
            first, rest = text.split("\n", 1)
            reports[stream, seq] = pending.get(stream, "") + first
            pending[stream] = rest
        else:
            pending[stream] = pending.get(stream, "") + text
    return reports, pending


def frame(spark, rows):
    return spark.createDataFrame(rows, "stream_id bigint, seq bigint, text string").repartition(3)


@pytest.mark.parametrize("rows_per_block", [1, 7, 65536])
@pytest.mark.parametrize("unit", ["char", "byte"])
def test_cursor_equals_the_fold(spark, rows_per_block, unit):
    rows, starts = random_chunks(), {0: (3, 9), 4: (1, 2)}
    first = spark.createDataFrame([(s, *p) for s, p in starts.items()], "stream_id bigint, line int, character int")
    cursor = ch.stream_cursor(frame(spark, rows), first, unit, rows_per_block)
    found = {
        (r["stream_id"], r["seq"]): (r["insert_line"], r["insert_character"], r["next_line"], r["next_character"])
        for r in cursor.collect()
    }
    assert found == literal_cursor(rows, starts, len if unit == "char" else lambda t: len(t.encode()))


@pytest.mark.parametrize("rows_per_block", [1, 7, 65536])
def test_lines_equal_the_fold(spark, rows_per_block):
    rows = random_chunks(seed=8)
    pieces = ch.open_pieces(frame(spark, rows), rows_per_block=rows_per_block)
    lines = ch.close_reports(pieces).collect()
    reports, pending = literal_progress(rows)
    assert {(r["stream_id"], r["seq"]): r["message"] for r in lines} == reports
    left = {}
    for r in sorted(pieces.where("not closed").collect(), key=lambda r: (r["stream_id"], r["seq"], r["place"])):
        left[r["stream_id"]] = left.get(r["stream_id"], "") + r["piece"]
    assert left == pending


def test_full_text_of_many_blocks_is_whole(spark):
    rows = random_chunks(seed=9, hot=5000)
    found = ch.stream_full_text(frame(spark, rows)).collect()
    texts = {}
    for stream, _, text in sorted(rows):
        texts[stream] = texts.get(stream, "") + text
    assert {r["stream_id"]: r["full_text"] for r in found} == texts and len(found) == len(texts)


def test_a_text_that_fits_no_row_stops_the_job(spark):
    block = scale.seq_block("seq", 2)
    joined = scale.concat_in_order(frame(spark, random_chunks(seed=9)), ["stream_id"], ["seq"], "text", block, max_bytes=3)
    with pytest.raises(Exception, match="longer than a row can hold"):
        joined.collect()


def test_running_totals(spark):
    rows = [(0, i, i % 5) for i in range(1000)] + [(k, i, 1) for k in range(1, 20) for i in range(k)]
    df = spark.createDataFrame(rows, "g int, seq bigint, n int")
    totals = scale.running_totals(df, ["g"], ["seq"], scale.seq_block("seq", 64), {"total": F.col("n")}).collect()
    found, sums = {(r["g"], r["seq"]): r["total"] for r in totals}, {}
    expected = {}
    for g, seq, n in sorted(rows):
        sums[g] = sums.get(g, 0) + n
        expected[g, seq] = sums[g]
    assert found == expected


def test_blocks_spread_a_group_that_is_partitioned_already(spark):
    df = spark.range(10000).select((F.col("id") % 2).alias("g"), F.col("id").alias("seq")).repartition("g")
    totals = scale.running_totals(df, ["g"], ["seq"], scale.seq_block("seq", 100), {"n": F.lit(1)})
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(g#\d+L, _block#\d+L", plan)
    assert totals.agg(F.max("n")).first()[0] == 5000


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_unique_with_a_hot_key(spark, how):
    left = spark.range(30000).select("id", F.when(F.col("id") < 10000, 7).otherwise(F.col("id") % 3000).alias("k"))
    right = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    salted = scale.join_unique(left, right, ["k"], how, rows_per_salt=500)
    plain = left.join(right, ["k"], how)
    assert sorted(salted.columns) == sorted(plain.columns)
    assert salted.select("id", "k", "v").exceptAll(plain.select("id", "k", "v")).isEmpty()
    assert salted.count() == plain.count()


def test_running_symbol_totals_follow_the_walk(spark):
    names = ["a.txt", "a/b", "a/c/d", "a/c.x", "b", "Z/q", "a-b/c"]
    rows = [("w", path, n + 1) for n, path in enumerate(names)] + [("v", "x", 5)]
    df = spark.createDataFrame(rows, "workspace string, path string, n_symbols bigint")
    found = {(r["workspace"], r["path"]): r["total_symbols"] for r in ix.running_symbol_totals(df).collect()}
    expected, total = {("v", "x"): 5}, 0
    for path in sorted(names, key=lambda p: p.split("/")):
        total += names.index(path) + 1
        expected["w", path] = total
    assert found == expected


@pytest.mark.parametrize("rows_per_block", [1, 7, 4096])
def test_join_in_blocks_equals_the_join(spark, rows_per_block):
    rng = random.Random(3)
    rows = lambda n: [(rng.choice(["hot"] * 6 + ["a", "b", None]), k // 2) for k in range(n)]
    left, right = spark.createDataFrame(rows(60), "k string, x int"), spark.createDataFrame(rows(40) + [("c", 1)], "k string, y int")
    found = scale.join_in_blocks(left, right, ["k"], rows_per_block)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, left.join(right, ["k"]).collect()))


def test_join_in_blocks_takes_as_many_tasks_as_pairs_need(spark):
    """Small sides of many pairs: adaptive execution must not merge their tasks by bytes."""
    left, right = spark.range(800).selectExpr("id % 8 AS k", "id AS x"), spark.range(800).selectExpr("id % 8 AS k", "id AS y")
    found = scale.join_in_blocks(left, right, ["k"], 25, 1600).groupBy(F.spark_partition_id()).count()
    per_task = [r["count"] for r in found.collect()]
    assert sum(per_task) == 80_000 and len(per_task) > 25 and max(per_task) < 10_000
    assert scale.join_in_blocks(left.where("x < 0"), right, ["k"]).collect() == []


def test_linked_definitions_deals_a_hot_class_to_tasks(spark):
    """A class with many nodes and definitions: its links come from many tasks."""
    from symloom.operators import graph as gr

    members = spark.range(9000).selectExpr("'w' AS workspace", "'c' AS class_id", "concat('p', id) AS path")
    definitions = spark.range(9000).selectExpr("'w' AS workspace", "'c' AS class_id", "concat('p', id) AS def_path")
    plain = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        links = gr.linked_definitions(members, definitions)
        per_task = [r["count"] for r in links.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(per_task) == 81_000_000 and max(per_task) < 60_000_000
