import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from symloom.functions import names
from symloom.operators import graph as gr
from symloom.operators import search as se
from symloom.operators import symbols as sy
from symloom.operators.name_index import NameIndex


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(se, "VECTORS_PER_BLOCK", block)
    monkeypatch.setattr(se, "QUERIES_PER_BLOCK", block)
    rng = np.random.default_rng(1)
    vectors = {(w, f"{w}{i:03}"): [float(x) for x in rng.integers(0, 3, 4)] for w in "uv" for i in range(150)}
    queries = {(w, i): [float(x) for x in rng.random(4) * 2] for w in "uvx" for i in range(10)}
    rows = [(*key, vector) for key, vector in vectors.items()] + [("u", "none", None)]
    embeddings = spark.createDataFrame(rows, "workspace string, symbol_id string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(*key, q) for key, q in queries.items()], "workspace string, query_id int, embedding array<double>")
    found = {}
    for r in sorted(se.nearest_symbols(embeddings, asked).collect(), key=lambda r: r["rank"]):
        found.setdefault((r["workspace"], r["query_id"]), []).append(r["symbol_id"])
    wanted = {}
    for (workspace, number), query in queries.items():
        far = {name: sum((a - b) ** 2 for a, b in zip(v, query, strict=True)) ** 0.5 for (w, name), v in vectors.items() if w == workspace}
        if far:
            wanted[workspace, number] = sorted(far, key=lambda name: (far[name], name))[:10]
    assert found == wanted


def test_embedding_of_words(spark):
    texts = ["Foo bar foo", "  ", "", "été Été"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", se.embed_text(F.col("text")).alias("e")).orderBy("id").collect()
    assert [len(r["e"]) for r in rows] == [64] * 4
    assert sorted(x for x in rows[0]["e"] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert not any(rows[1]["e"]) and not any(rows[2]["e"])
    # Only A to Z fold, so the two words differ.
    assert sorted(x for x in rows[3]["e"] if x) == pytest.approx([0.5**0.5] * 2)


def test_own_model(spark):
    def lengths(texts: pd.Series) -> np.ndarray:
        return np.stack([texts.str.len(), texts.str.count("a")], axis=1)

    df = spark.createDataFrame([("banana",)], "text string")
    assert list(df.select(se.embed_text(F.col("text"), lengths)).first()[0]) == [6.0, 3.0]


def code(spark):
    files = spark.createDataFrame(
        [
            ("w", "a.py", "def parse_file():\n  open read lines\n\ndef write_file():\n  open write bytes\n"),
            ("w", "b.py", "class Parser:\n  tokens stream read\n"),
        ],
        "workspace string, path string, text string",
    )
    return sy.symbol_table(sy.extract_symbols(files, with_text=True, corrected=True))


def test_hybrid_gate(spark):
    symbols = code(spark)
    embeddings = se.embed_symbols(symbols).select("workspace", "symbol_id", "embedding")
    asked = ["PARSE", "tokens stream read", "no space here".replace(" ", ""), "a b", "ünï cödé", ""]
    queries = spark.createDataFrame([("w", i, q) for i, q in enumerate(asked)], "workspace string, query_id int, query string")
    rows = se.hybrid_symbol_search(symbols, embeddings, queries).collect()
    found = {
        i: [(r["source"], r["name"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == i]
        for i in range(len(asked))
    }
    assert found[0] == [("prefix", "parse_file"), ("prefix", "Parser")]
    assert found[1][0] == ("semantic", "Parser") and len(found[1]) == 3
    assert found[2] == [] and found[3] == []
    # Eight characters, but more than ten bytes.
    assert {source for source, _ in found[4]} == {"semantic"}
    assert len(found[5]) == 3 and found[5][0][0] == "prefix"


def test_hybrid_search_stays_in_its_workspace(spark):
    files = spark.createDataFrame(
        [("w1", "a.py", "def foo():\n  read tokens\n"), ("w2", "b.py", "def bar():\n  read tokens\n")],
        "workspace string, path string, text string",
    )
    symbols = sy.symbol_table(sy.extract_symbols(files, with_text=True, corrected=True))
    embeddings = se.embed_symbols(symbols).select("workspace", "symbol_id", "embedding")
    asked = [("w1", 0, "read tokens here"), ("w2", 0, "read tokens here"), ("w1", 1, "bar"), ("w3", 2, "read tokens here")]
    queries = spark.createDataFrame(asked, "workspace string, query_id int, query string")
    rows = se.hybrid_symbol_search(symbols, embeddings, queries).collect()
    assert {(r["workspace"], r["query_id"], r["name"]) for r in rows} == {("w1", 0, "foo"), ("w2", 0, "bar")}


def test_queries_without_a_literal_start_are_spread(spark):
    symbols = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 7)).alias("workspace"),
        F.concat(F.lit("f"), "id").alias("path"), F.lit(0).alias("start_line"), F.lit(0).alias("start_col"),
        F.concat(F.lit("name"), "id").alias("name"), F.concat(F.lit("name"), "id").alias("name_fold"),
    )
    queries = spark.createDataFrame([("hot", 1, "%9"), ("hot", 2, ""), ("w1", 3, "name1")], "workspace string, query_id int, query string")
    matches = se.prefix_matches(symbols, queries)
    plan = matches._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan
    assert matches.where("query_id = 2").count() == symbols.where("workspace = 'hot'").count()
    assert matches.where("query_id = 1").count() == symbols.where("workspace = 'hot' and name like '%9%'").count()


def test_prefix_search_of_many_equals_one_by_one(spark):
    symbols = code(spark)
    asked = ["p", "PARSE", "parse_", "write_file_x", "%file", "_arse", "", "w%e"]
    queries = spark.createDataFrame([("w", q, q) for q in asked], "workspace string, query_id string, query string")
    rows = se.prefix_search_many(symbols, queries, limit=2).collect()
    for query in asked:
        one = [r["name"] for r in se.symbol_prefix_search(symbols, query, limit=2).collect()]
        assert one == [r["name"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == query]


def named_symbols(spark, rows):
    symbols = spark.createDataFrame(rows, "workspace string, path string, name string")
    return symbols.withColumn("name_fold", names.fold_name(F.col("name"))).withColumn("start_line", F.lit(1)).withColumn("start_col", F.lit(0))


def test_name_index_equals_a_scan(spark, tmp_path):
    letters = ["a", "B", "_", "%", "é", "日", "\U0010ffff", "z"]
    rng = random.Random(4)
    rows = [("w" if k % 3 else "w2", f"f{k:05d}", "".join(rng.choice(letters) for _ in range(rng.randint(0, 4)))) for k in range(3000)]
    rows += [("w", f"hot{k:05d}", "main") for k in range(1500)] + [("w", "n", None), (None, "n", "ab"), ("", "e", "ab")]
    symbols = named_symbols(spark, rows)
    asked = ["a", "AB", "b_", "%", "_", "", "é", "日z", "\U0010ffff", "z%a", "main", "mainly", "m", "q", None]
    queries = spark.createDataFrame(
        [(w, f"q{k}", q) for w in ("w", "w2", "", "x", None) for k, q in enumerate(asked)], "workspace string, query_id string, query string"
    )
    index = NameIndex(spark, f"{tmp_path}/names")
    index.write(symbols, parts=12, rows_per_page=64)
    stored = spark.read.parquet(f"{tmp_path}/names/parts").collect()
    assert len(stored) > 8 and max(r["n_rows"] for r in stored) < 1500
    columns = ["workspace", "query_id", "rank", "path", "name"]
    for corrected in (False, True):
        scanned = se.prefix_search_many(symbols, queries, limit=50, corrected=corrected).select(columns)
        found = index.search(queries, limit=50, corrected=corrected).select(columns)
        assert sorted(found.collect()) == sorted(scanned.collect())
        assert index.matches(queries, corrected).count() == se.prefix_matches(symbols, queries, corrected).count()


def test_name_index_opens_the_interval_only(spark, tmp_path):
    symbols = named_symbols(spark, [("w", f"f{k}", f"name{k:05d}") for k in range(4000)])
    index = NameIndex(spark, f"{tmp_path}/names")
    index.write(symbols, parts=16, rows_per_page=32)
    queries = spark.createDataFrame(
        [("w", "ten", "name0123"), ("w", "one", "name03999"), ("w", "all", "n"), ("w", "none", "zebra"), ("v", "other", "n")],
        "workspace string, query_id string, query string",
    )
    reads = {r["query_id"]: r for r in index.reads(queries, corrected=True).collect()}
    assert reads["ten"]["n_parts"] <= 2 and reads["ten"]["n_pages"] <= 2 and reads["ten"]["n_rows"] <= 64
    assert reads["one"]["n_parts"] == reads["one"]["n_pages"] == 1 and reads["all"]["n_rows"] == 4000
    assert 0 < reads["one"]["n_bytes"] * 4 < reads["all"]["n_bytes"]
    assert all(reads[q]["n_parts"] == reads[q]["n_bytes"] == 0 for q in ("none", "other"))
    plan = index.matches(queries.where("query_id = 'one'"), True)._jdf.queryExecution().toString()
    assert "Generate explode(filter" not in plan and "PartitionFilters" in plan


def test_empty_name_index(spark, tmp_path):
    symbols = named_symbols(spark, []).withColumn("extra", F.lit("x"))
    index = NameIndex(spark, f"{tmp_path}/names")
    index.write(symbols)
    queries = spark.createDataFrame([("w", "q", "a")], "workspace string, query_id string, query string")
    assert index.search(queries).collect() == [] and "extra" in index.search(queries).columns
    assert [r["n_parts"] for r in index.reads(queries).collect()] == [0]


def test_extraction_rules(spark):
    files = spark.createDataFrame(
        [
            ("w", "a.go", "package x\nfunc Foo() {\n}\n\ntype Bar struct {\n x int\n}\nfunc (b *Bar) Baz() {}"),
            ("w", "b.ts", "export default class A {}\nexport const enum E {}\ninterface I {}\nasync function f() {}\n"),
            ("w", "c.rs", "fn main() {}\n"),
            ("w", "d.py", "\u0000def f(): pass\n"),
            ("w", "e.py", ""),
        ],
        "workspace string, path string, text string",
    )
    rows = sy.extract_symbols(files).orderBy("path", "symbol_no").collect()
    assert [(r["path"], r["name"], r["kind"], r["start_line"], r["end_line"], r["end_col"]) for r in rows] == [
        ("a.go", "Foo", 12, 1, 3, 0),
        ("a.go", "Bar", 13, 4, 6, 1),
        ("a.go", "Baz", 6, 7, 7, 22),
        ("b.ts", "A", 5, 0, 0, 25),
        ("b.ts", "E", 10, 1, 1, 22),
        ("b.ts", "I", 11, 2, 2, 14),
        ("b.ts", "f", 12, 3, 4, 0),
    ]


def test_references_of_code(spark):
    files = spark.createDataFrame(
        [("w", "a.go", "func Foo() {\n  Bar(x.Field)\n  y := pkg.Type{}\n}\nfunc Bar(n int) {}\n"), ("w", "b.rs", "x.y()")],
        "workspace string, path string, text string",
    )
    found = sy.extract_references(files)
    assert sorted((r["line"], r["start_col"], r["end_col"], r["node_type"], r["content"]) for r in found.collect()) == [
        (1, 2, 5, "identifier", "Bar"),
        (1, 8, 13, "field_identifier", "Field"),
        (2, 11, 15, "field_identifier", "Type"),
        (2, 11, 15, "type_identifier", "Type"),
    ]
    symbols = sy.symbol_table(sy.extract_symbols(files))
    resolved = gr.resolve_references(found, symbols).collect()
    assert [(r["content"], r["uid"]) for r in resolved] == [("Bar", "a.go 4:0-5:0")]


def test_captures_after_a_lead_and_in_long_lines(spark):
    rules = [sy.Rule(("go",), "after", r"(?:new|old) (\w+)"), sy.Rule(("go",), "arrow", r"->(\w)")]
    lines = ["new new", "é new é new x old new old", "->a->b", "x" * 3000 + "->y" * 800, ""]
    files = spark.createDataFrame([("w", "a.go", "\n".join(lines))], "workspace string, path string, text string")
    found = sy.extract_references(files, rules)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    wanted = [
        (n, m.start(1), m.end(1), rule.kind, m.group(1))
        for n, line in enumerate(lines) for rule in rules for m in re.finditer(rule.pattern, line)
    ]
    rows = [(r["line"], r["start_col"], r["end_col"], r["node_type"], r["content"]) for r in found.collect()]
    assert sorted(rows) == sorted(wanted)


def test_resolution_prefers_the_own_file(spark):
    files = spark.createDataFrame(
        [("w", "a.go", "func Run() {}"), ("w", "b.go", "func Run() {}\nRun()"), ("w", "c.go", "Run()"), ("v", "c.go", "Run()")],
        "workspace string, path string, text string",
    )
    symbols = sy.symbol_table(sy.extract_symbols(files))
    rows = gr.resolve_references(sy.extract_references(files), symbols).collect()
    assert {(r["workspace"], r["path"], r["def_path"]) for r in rows} == {("w", "b.go", "b.go"), ("w", "c.go", "a.go")}


def test_enclosing_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    definitions, places = [], []
    for path in ("p", "q", "r"):
        for _ in range(25):
            start, size = int(rng.integers(0, 60)), int(rng.integers(0, 15))
            definitions.append(("w", path, start, int(rng.integers(0, 3)), start + size, 3 + int(rng.integers(0, 3))))
        for n in range(60):
            line, column = int(rng.integers(0, 75)), int(rng.integers(0, 7))
            places.append(("w", path, f"{path}{n}", line, column))
    symbols = spark.createDataFrame(
        definitions, "workspace string, path string, start_line int, start_col int, end_line int, end_col int"
    )
    locations = spark.createDataFrame(places, "workspace string, path string, uid string, start_line int, start_col int")
    found = {r["uid"]: (r["start_line"], r["start_col"], r["end_line"], r["end_col"]) for r in gr.enclosing_definition(locations, symbols).collect()}
    expected = {}
    for _, path, uid, line, column in places:
        around = [d[2:] for d in definitions if d[1] == path and d[2:4] <= (line, column) <= d[4:6]]
        if around:
            expected[uid] = min(around, key=lambda d: (d[0], d[1], -d[2], -d[3]))
    assert {u: (found.get(u), expected.get(u)) for u in {*found, *expected} if found.get(u) != expected.get(u)} == {}


def test_vector_index_reads_the_cells_it_needs(spark, tmp_path):
    """Vectors around many centres, one workspace with most of them, equal vectors and a workspace of two."""
    from symloom.operators.vectors import VectorIndex

    rng = np.random.default_rng(3)
    middles = rng.normal(0, 10, (60, 16))
    rows = [("big", f"s{k:05d}", (middles[k % 60] + rng.normal(0, 0.3, 16)).tolist()) for k in range(3000)]
    rows += [("big", f"t{k}", rows[0][2]) for k in range(12)] + [("few", "a", [0.0] * 16), ("few", "b", [1.0] * 16), ("few", "c", None)]
    vectors = spark.createDataFrame(rows, "workspace string, symbol_id string, embedding array<double>")
    asked = [("big", k, (middles[k] + rng.normal(0, 0.1, 16)).tolist()) for k in range(20)]
    asked += [("big", 100, rows[0][2]), ("few", 7, [0.4] * 16), ("none", 8, [0.0] * 16)]
    queries = spark.createDataFrame(asked, "workspace string, query_id int, embedding array<double>")
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.write(vectors)
    found = sorted(tuple(r) for r in index.nearest(queries, 10).collect())
    assert found == sorted(tuple(r) for r in se.nearest_symbols(vectors, queries, 10).collect())
    assert [r[2] for r in found if r[0] == "few"] == ["a", "b"] and len(found) == 212
    read, _ = index.visits(queries.where("workspace = 'big'"), 10)
    held = index.cells().where("workspace = 'big'").count()
    assert held > 40 and read.count() < 21 * held / 8


def test_an_empty_vector_index(spark, tmp_path):
    from symloom.operators.vectors import VectorIndex

    schema = "workspace string, symbol_id string, embedding array<double>"
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.write(spark.createDataFrame([], schema))
    queries = spark.createDataFrame([("w", 1, [0.0])], "workspace string, query_id int, embedding array<double>")
    assert index.nearest(queries).collect() == []


def test_vectors_of_a_workspace_are_not_brought_together_for_their_number(spark):
    """Only the numbers of blocks are sent around: no join of all vectors by workspace."""
    rows = [("w" if k % 5 else "v", f"s{k:03}", [float(k), 1.0]) for k in range(60)] + [("u", "s", [0.0, 0.0]), (None, "t", [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "workspace string, symbol_id string, embedding array<float>")
    blocks = se._vector_blocks(vectors, "symbol_id", 10, "symbol")
    assert "SortMergeJoin" not in blocks._jdf.queryExecution().executedPlan().toString()
    assert {(r["workspace"], r["symbol_blocks"]) for r in blocks.collect()} >= {("w", 5), ("v", 2), ("u", 1)}
    assert sorted(k for r in blocks.collect() for k in r["symbol_keys"]) == sorted(r[1] for r in rows)


def test_a_text_of_many_queries_is_looked_up_once(spark, monkeypatch):
    rows = [("w", f"p{k}", 0, 0, name, name.lower()) for k, name in enumerate(["Theory", "Then", "Other", "Theme"])]
    symbols = spark.createDataFrame(rows, "workspace string, path string, start_line int, start_col int, name string, name_fold string")
    queries = spark.createDataFrame(
        [("w", "a", "the"), ("w", "b", "the"), ("w", "c", "the"), ("w", "c", "oth"), ("w", None, "the"), ("v", "a", "the"), ("w", "d", None)],
        "workspace string, query_id string, query string",
    )
    asked, matches = [], se.prefix_matches
    monkeypatch.setattr(se, "prefix_matches", lambda s, texts, corrected=False: asked.append(texts.count()) or matches(s, texts, corrected))
    found = se.prefix_search_many(symbols, queries, limit=2)
    got = sorted((r["query_id"] or "", r["rank"], r["name"]) for r in found.collect())
    # One query id with two texts ranks the hits of both.
    assert got == [(q, n, name) for q in ["", "a", "b", "c"] for n, name in ((1, "Theory"), (2, "Then"))]
    assert asked == [4]


def test_references_take_one_pass_over_a_line(spark):
    rule = sy.Rule(("de",), "word", "([A-Z][a-z]+)")
    line = F.col("line")
    lines = spark.createDataFrame([("Ab cDe $1 \\ Fgh",), ("",), ("none",), ("AbCd",)], "line string")
    found = lines.select("line", sy._captures(line, F.lit(3), rule).alias("found"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_") == 1
    got = {r["line"]: [(c["start_col"], c["end_col"], c["content"]) for c in r["found"]] for r in found.collect()}
    assert got == {"Ab cDe $1 \\ Fgh": [(0, 2, "Ab"), (4, 6, "De"), (12, 15, "Fgh")], "": [], "none": [], "AbCd": [(0, 2, "Ab"), (2, 4, "Cd")]}
