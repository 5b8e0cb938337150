import json
from collections import Counter

from pyspark.sql import functions as F

from symloom.functions import text as tx
from symloom.operators import config as cf
from symloom.operators import graph as gr
from symloom.operators import index as ix
from symloom.operators import stats as st
from symloom.operators import symbols as sy
from symloom.sources import tables as tb

FILE = "workspace string, path string, md5 string"
SYMBOL = "workspace string, path string, name string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_replace_keeps_or_drops_files_that_are_gone(spark):
    old = spark.createDataFrame([("w", "a", "1"), ("w", "b", "1"), ("w", "gone", "1"), ("v", "a", "1")], FILE)
    old_symbols = spark.createDataFrame([("w", "a", "x"), ("w", "b", "y"), ("w", "gone", "z"), ("v", "a", "x")], SYMBOL)
    scan = spark.createDataFrame([("w", "a", "2"), ("w", "b", "1"), ("w", "new", "1"), ("v", "a", "1")], FILE)
    changed = ix.detect_changed_files(scan, old)
    assert rows(changed, "path") == [("a",), ("new",)]
    assert rows(ix.skip_unchanged_files(scan, old), "workspace", "path") == [("v", "a"), ("w", "b")]
    new_symbols = spark.createDataFrame([("w", "a", "X")], SYMBOL)

    files, symbols = ix.replace_file_index(old, old_symbols, changed, new_symbols)
    kept = [("v", "a", "1"), ("w", "a", "2"), ("w", "b", "1"), ("w", "gone", "1"), ("w", "new", "1")]
    assert rows(files, "workspace", "path", "md5") == kept
    assert rows(symbols, "workspace", "name") == [("v", "x"), ("w", "X"), ("w", "y"), ("w", "z")]

    files, symbols = ix.replace_file_index(old, old_symbols, changed, new_symbols, scan)
    assert ("w", "gone", "1") not in rows(files, "workspace", "path", "md5") and files.count() == 4
    assert rows(symbols, "workspace", "name") == [("v", "x"), ("w", "X"), ("w", "y")]


def test_report(spark):
    files = spark.createDataFrame(
        [("w", "a b.go", 'func F() {\n}\ntype T struct{}'), ("w", "c.txt", "x")], "workspace string, path string, text string"
    )
    located = sy.symbol_location_struct(sy.symbol_table(sy.extract_symbols(files)), "/r")
    reports = {r["path"]: json.loads(r["report"]) for r in tb.index_report_json(files, located).collect()}
    assert reports["c.txt"] == {"symbols": None}
    assert reports["a b.go"]["symbols"][0] == {
        "name": "F",
        "kind": 12,
        "location": {
            "uri": "file:///r/a%20b.go",
            "range": {"start": {"line": 0, "character": 0}, "end": {"line": 1, "character": 1}},
        },
        "RelativePath": "a b.go",
        "Description": "",
        "Embedding": None,
    }
    assert [s["name"] for s in reports["a b.go"]["symbols"]] == ["F", "T"]


def test_context_json(spark):
    files = spark.createDataFrame(
        [("w", "a.go", "func F() {\n  G(G(1))\n}"), ("w", "b.go", "func G() {}")], "workspace string, path string, text string"
    )
    resolved = gr.resolve_references(sy.extract_references(files), sy.symbol_table(sy.extract_symbols(files)))
    definitions = gr.definition_texts(gr.distinct_locations(resolved), files)
    context = gr.code_context(gr.group_captures(resolved), definitions)
    requests = files.select("workspace", "path", F.lit(1).alias("line"))
    rows = gr.context_graph_json(context, files, requests, "rules").collect()
    graph = {(r["path"], r["uid"]): json.loads(r["context"]) for r in rows}
    uid = "b.go 0:0-0:11"
    node = lambda start: {
        "id": uid, "content": "G", "start": {"line": 1, "column": start}, "end": {"line": 1, "column": start + 1},
        "type": "identifier",
    }
    assert graph == {
        ("a.go", None): {"file": "func F() {\n  G(G(1))\n}", "line": 1, "queries": "rules"},
        ("b.go", None): {"file": "func G() {}", "line": 1, "queries": "rules"},
        ("a.go", uid): {"captures": {uid: [node(2), node(4)]}, "definitions": {uid: "func G() {}"}, "line": 1},
    }


def test_own_definitions_are_cut_in_their_file(spark):
    """Only definitions of other files are given; the rows are those of all definitions, each line asked for once more."""
    files = spark.createDataFrame(
        [
            ("w", "a.go", "func F() {\n  G(F(1))\n}\nfunc H() { F(2) }"), ("w", "b.go", "func G() { H(G(1)) }"),
            ("w", "a 0:0-1:1.go", "func K() { K(F(1)) }"), ("w", "twice.go", "func T() { T(1) }"), ("w", "twice.go", "func T() { T(1) }"),
        ],
        "workspace string, path string, text string",
    )
    resolved = gr.resolve_references(sy.extract_references(files), sy.symbol_table(sy.extract_symbols(files)))
    captures = gr.group_captures(resolved)
    texts = lambda part: gr.definition_texts(gr.distinct_locations(part), files)
    every = gr.code_context(captures, texts(resolved))
    columns = ["workspace", "path", "uid", "nodes", "definition"]
    others = texts(resolved.where("path <> def_path"))
    assert rows(gr.code_context(captures, others, files), *columns) == rows(every, *columns)
    assert others.count() < texts(resolved).count()
    lost = gr.code_context(captures, others, files.where("path <> 'twice.go'"))
    assert [tuple(r)[1:] for r in lost.where("definition IS NULL").select("workspace", "path", "uid").collect()] == [("twice.go", "twice.go 0:0-0:17")]

    requests = files.select("workspace", "path", F.explode(F.array(F.lit(1), F.lit(7))).alias("line"))
    asked = gr.code_context(captures.join(requests, ["workspace", "path"]), others, files)
    graph = lambda context: Counter(map(tuple, gr.context_graph_json(context, files, requests).collect()))
    found = graph(asked)
    assert found == graph(every)
    assert sum(n for r, n in found.items() if r[1] == "twice.go" and r[3]) == 8


def test_places_of_definitions_are_read_back(spark):
    names = ["path", "start_line", "start_col", "end_line", "end_col"]
    places = [("a b 1:2-3:4.go", 0, 1, 22, 333), ("", 5, 6, 7, 8), ("x", None, 0, 1, 2)]
    uids = spark.createDataFrame(places, "path string, start_line int, start_col int, end_line int, end_col int")
    place = tx.definition_place(tx.definition_uid(*[F.col(n) for n in names]))
    assert [tuple(r) for r in uids.select(place.alias("p")).select("p.*").collect()] == places


def test_classes_hold_all_links_without_pairs(spark):
    nodes = [("w", f"n{k:04d}", 1, k, "hot" if k % 3 else f"name{k % 5}") for k in range(600)]
    nodes += [("v", "n", 1, 0, "hot"), ("w", "n", 1, 0, "lost"), ("w", "n", 2, 0, None), (None, "n", 3, 0, "hot"), ("w", "n", 4, 0, "name0")]
    nodes += [nodes[0]]
    references = spark.createDataFrame(nodes, "workspace string, path string, line int, start_col int, content string")
    places = [("w", f"n{k:04d}", "hot", k) for k in range(0, 300)] + [("w", f"d{k}", f"name{k % 4}", k) for k in range(9)]
    places += [("u", "d", "hot", 0), ("w", "d", "unused", 0), ("w", "d", None, 1), (None, "d", "hot", 2)]
    symbols = spark.createDataFrame(places, "workspace string, path string, name string, start_line int").selectExpr(
        "*", "0 AS start_col", "start_line AS end_line", "3 AS end_col"
    )
    classes, definitions, members = gr.name_classes(references, symbols)
    wanted = sorted(
        (w, p, line, col, f"{d} {at}:0-{at}:3", d == p)
        for w, p, line, col, name in nodes for v, d, other, at in places
        if w is not None and name is not None and (w, name) == (v, other)
    )
    links = gr.linked_definitions(members, definitions)
    assert rows(links, "workspace", "path", "line", "start_col", "uid", "in_file") == wanted
    assert sum(r["n_links"] for r in classes.collect()) == len(wanted)
    assert {(r["workspace"], r["content"]) for r in classes.collect()} == {("w", "hot"), *(("w", f"name{k}") for k in range(4))}
    assert members.count() + definitions.count() < len(wanted) / 50
    none = gr.name_classes(references.limit(0), symbols)
    assert [frame.count() for frame in none] == [0, 0, 0]


def test_config_by_path_beats_name(spark):
    config = spark.createDataFrame(
        [("z", "/x/app", ["i1"], ["e1"]), ("y", "/x/app", ["i2"], None), ("app", None, ["i3"], ["e3"]), ("lib", "/q/lib", None, None)],
        "name string, path string, include array<string>, exclude array<string>",
    )
    directories = spark.createDataFrame([("/x/app",), ("/other/app",), ("/q/none/",), ("/q/lib",)], "directory string")
    found = {r["directory"]: (r["config_name"], r["include"], r["exclude"], r["matched_by"]) for r in cf.resolve_workspace_config(directories, config).collect()}
    assert found == {
        "/x/app": ("y", ["i2"], [], "path"),
        "/other/app": ("app", ["i3"], ["e3"], "name"),
        "/q/none/": ("none", [], [], "default"),
        "/q/lib": ("lib", [], [], "path"),
    }


def test_stats(spark):
    samples = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("b", 4), ("b", 5)], "source string, nanos bigint")
    assert rows(st.duration_stats(samples, ["source"]), "source", "avg_nanos", "min_nanos", "max_nanos") == [
        ("a", 2, 1, 5),
        ("b", 4, 4, 5),
    ]
    slow = st.duration_ratio(samples, "source", "b", "a").first()
    assert (slow["ratio"], slow["verdict"]) == (2.0, "slower")
    assert st.duration_ratio(samples, "source", "a", "a").first()["verdict"] == "faster"
    listing = st.compare_listings(samples, samples.where("nanos > 4")).first()
    assert tuple(listing) == (5, 2, True)


def test_failed_and_empty_files_stay(spark):
    files = spark.createDataFrame(
        [("w", "a.py", "def f(): pass"), ("w", "b.py", "\u0000"), ("w", "c.md", "# t")],
        "workspace string, path string, text string",
    )
    per_file = ix.symbols_per_file(files, sy.extract_symbols(files))
    assert rows(per_file, "path", "n_symbols") == [("a.py", 1), ("b.py", 0), ("c.md", 0)]
    assert tuple(ix.index_totals(per_file).first()) == (3, 1)
    assert rows(ix.failed_files(sy.add_text_errors(files)), "path") == [("b.py",)]
    marked = sy.supported_language_filter(files)
    assert rows(marked, "path", "supported") == [("a.py", True), ("b.py", True), ("c.md", False)]
