import hashlib
import os

import pytest
from pyspark.sql import functions as F

from symloom.functions import names, paths
from symloom.sources import files as fl
from symloom.sources import tables as tb
from symloom.sources.manifest import Change, ManifestIndex

TREE = {
    "main.go": b"package main\n",
    "pkg/__init__.py": b"",
    "pkg/mod ule.py": b"def f(): pass\n",
    "pkg/deep/_x/b.go": b"package b\n",
    ".github/w.yml": b"on: push\n",
    "ü/näme.js": b"let a\n",
    "vendor/v.go": b"package v\n",
    "bin/raw": bytes(range(256)),
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tree")
    for path, content in TREE.items():
        os.makedirs(folder / os.path.dirname(path), exist_ok=True)
        (folder / path).write_bytes(content)
    (folder / "empty_dir").mkdir()
    os.symlink(folder / "vendor", folder / "linked_dir")
    os.symlink(folder / "main.go", folder / "linked.go")
    os.symlink(folder / "gone", folder / "dangling")
    return str(folder)


def scanned(df, root):
    return {r["path"][len(root) + 1 :]: bytes(r["content"]) for r in df.where("error is null").collect()}


def test_scan_reads_every_file(spark, root):
    assert scanned(fl.scan_files(spark, root), root) == {**TREE, "linked.go": TREE["main.go"]}


def test_what_cannot_be_read_says_so(spark, root):
    failed = fl.read_failures(fl.scan_files(spark, root), "w", root).collect()
    assert [(r["workspace"], r["path"]) for r in failed] == [("w", "dangling")]
    missing = spark.createDataFrame([(f"{root}/nowhere",), ("dbfs:/x",), (f"{root}/main.go",)], "path string")
    rows = {r["path"]: (r["content"], r["error"]) for r in fl.read_contents(missing).collect()}
    assert rows[f"{root}/main.go"] == (TREE["main.go"], None)
    assert rows[f"{root}/nowhere"][0] is None and rows[f"{root}/nowhere"][1]
    assert "no file system" in rows["dbfs:/x"][1]


def test_only_regular_files_are_read(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    os.mkfifo(tmp_path / "pipe")
    assert [r["path"] for r in fl.scan_files(spark, str(tmp_path)).collect()] == [str(tmp_path / "a")]


@pytest.mark.parametrize(
    "path,default,inner",
    [
        ("/a/b c", "file:///", "/a/b c"),
        ("file:/a/b", "hdfs://n", "/a/b"),
        ("file:///a/b", "hdfs://n", "/a/b"),
    ],
)
def test_local_paths(path, default, inner):
    system, found = fl.open_filesystem(path, default=default)
    assert (system.type_name, found) == ("local", inner)


def test_a_path_without_scheme_lies_where_spark_says(spark, tmp_path):
    from symloom.session import default_filesystem, hadoop_path

    assert default_filesystem(spark) == "file:///"
    path, _ = hadoop_path(spark, str(tmp_path))
    assert path.toString() == f"file:{tmp_path}"
    index = ManifestIndex(spark, str(tmp_path / "t"), ranges=4)
    index.commit({"files": Change(file_rows(spark, a="1"))})
    assert os.path.isdir(tmp_path / "t" / "manifests") and ManifestIndex(spark, f"file:{tmp_path}/t").versions() == [1]


def file_rows(spark, **md5):
    return spark.createDataFrame([("w", name, value) for name, value in md5.items()], "workspace string, path string, md5 string")


def held(index, **at):
    return {r["path"]: r["md5"] for r in index.table("files", **at).collect()}


def test_a_commit_rewrites_the_ranges_of_its_files(spark, tmp_path):
    index = ManifestIndex(spark, str(tmp_path), ranges=16)
    assert index.table("files") is None
    many = file_rows(spark, **{f"f{k}": "old" for k in range(100)})
    assert index.commit({"files": Change(many), "symbols": Change(many.withColumn("name", F.col("path")))}) == 1
    one = file_rows(spark, f7="new")
    assert index.commit({"files": Change(one, one), "symbols": Change(one.withColumn("name", F.lit("n")), one)}) == 2
    entries = index.manifest()["tables"]["files"]["ranges"]
    assert sorted(e["version"] for e in entries.values()) == [1] * 15 + [2]
    assert held(index) == {f"f{k}": "new" if k == 7 else "old" for k in range(100)}
    assert index.table("symbols").where("name = 'n'").count() == 1 and index.table("symbols").count() == 100
    # Earlier versions can be read until they are removed.
    assert held(index, manifest=index.manifest(1))["f7"] == "old"
    gone = one.limit(0)
    index.commit({"files": Change(gone, one), "symbols": Change(gone.withColumn("name", F.lit("")), one)})
    index.vacuum(keep=1)
    assert index.versions() == [3] and len(held(index)) == 99
    assert len(list((tmp_path / "data").iterdir())) == 4


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both start from one version; the second to commit finds a newer one, in other ranges and in its own."""
    first, second = (ManifestIndex(spark, str(tmp_path), ranges=8) for _ in range(2))
    first.commit({"files": Change(file_rows(spark, **{f"f{k}": "0" for k in range(40)}))})
    base = second.manifest()
    mine, yours = file_rows(spark, **{f"f{k}": "1" for k in range(0, 12)}), file_rows(spark, **{f"f{k}": "2" for k in (3, 30, 35)})
    assert first.commit({"files": Change(mine, mine)}) == 2
    assert second.commit({"files": Change(yours, yours)}, batch=("s", 0), base=base) == 3
    # A batch that was committed before is not committed again, whoever asks.
    assert second.commit({"files": Change(mine, mine)}, batch=("s", 0), base=base) == 3
    expected = {f"f{k}": "2" if k in (3, 30, 35) else "1" if k < 12 else "0" for k in range(40)}
    assert held(first) == held(second) == expected


def test_writers_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def write(number):
        rows = file_rows(spark, **{f"f{number}": "x", f"g{number}": "y"})
        return ManifestIndex(spark, str(tmp_path), ranges=4).commit({"files": Change(rows, rows)})

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(write, range(6)))
    index = ManifestIndex(spark, str(tmp_path))
    assert sorted(versions) == index.versions() == [1, 2, 3, 4, 5, 6]
    assert len(held(index)) == 12 and index.manifest()["ranges"] == 4


def test_scan_takes_uris(spark, root):
    found = scanned(fl.scan_files(spark, "file://" + root), "file://" + root)
    assert set(found) == {*TREE, "linked.go"}


def test_excludes_cross_folders(spark, root):
    found = scanned(fl.scan_files(spark, root, ["*.go", "vendor/*", ".github/*"]), root)
    assert set(found) == {"pkg/__init__.py", "pkg/mod ule.py", "ü/näme.js", "bin/raw"}


def test_include_roots(spark, root):
    found = scanned(fl.scan_include_roots(spark, root, ["pkg", "v*/*.go", "main.go", "pkg/deep"], ["*.go"]), root)
    # Files that an include names are taken though an exclude matches them; walked files are not.
    assert set(found) == {"pkg/__init__.py", "pkg/mod ule.py", "vendor/v.go", "main.go"}


def test_include_must_stay_inside(spark, root):
    with pytest.raises(ValueError):
        fl.scan_include_roots(spark, root, ["../other"])


@pytest.mark.parametrize(
    "pattern,matches,misses",
    [
        ("*.go", ["a.go", "x/y/a.go"], ["a.gox", "go"]),
        ("v?/[ab]*", ["vx/a", "vx/bcd/e"], ["v/a", "vx/c"]),
        ("[!a]x", ["bx", "/x"], ["ax"]),
        ("{a,b?}.{c,d}", ["a.c", "bz.d"], ["b.c", "a.e"]),
        ("[a-c]", ["b"], ["d", "-"]),
        (r"\*", ["*"], ["a"]),
        ("a.b", ["a.b"], ["axb"]),
    ],
)
def test_exclude_globs(spark, pattern, matches, misses):
    df = spark.createDataFrame([(p,) for p in matches + misses], "path string")
    kept = df.where(paths.matches_any_glob(F.col("path"), [pattern])).collect()
    assert sorted(r["path"] for r in kept) == sorted(matches)


@pytest.mark.parametrize("pattern", ["[a", "{a,b", "x[]"])
def test_bad_globs(pattern):
    with pytest.raises(ValueError):
        paths.glob_to_regex(pattern)


def column(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    return [r["r"] for r in df.select("id", expression.alias("r")).orderBy("id").collect()]


def test_languages(spark):
    values = ["a.go", "x/b.test.ts", ".bashrc", "noext", "a.b/c", "d.", "e.TSX"]
    assert column(spark, paths.detect_language(F.col("v")), values) == ["go", "ts", "bashrc", "", "", "", "TSX"]


def test_file_uri(spark):
    values = ["a b.go", "ü/x+y.py", "p*q?r#s%t", "a,b;c=d@e&f$g~h:i"]
    assert column(spark, paths.file_uri(F.col("v"), "/r"), values) == [
        "file:///r/a%20b.go",
        "file:///r/%C3%BC/x+y.py",
        "file:///r/p%2Aq%3Fr%23s%25t",
        "file:///r/a,b;c=d@e&f$g~h:i",
    ]


def test_relative_path_outside_is_null(spark):
    assert column(spark, paths.relative_path(F.col("v"), "/r/"), ["/r/a/b", "/rx/a", "/r"]) == ["a/b", None, None]


def test_kinds(spark):
    values = ["class", "function", "method", "type", "module", "interface", "enum", "macro", "other", None]
    assert column(spark, names.map_symbol_kind(F.col("v")), values) == [5, 12, 6, 13, 2, 11, 10, 13, 13, 13]


@pytest.mark.parametrize(
    "prefix,plain,corrected",
    [
        ("fo", ["Foo", "foobar", "FO_x"], ["Foo", "foobar", "FO_x"]),
        ("fo_", ["Foo", "foobar", "FO_x"], ["FO_x"]),
        ("%x", ["FO_x"], []),
        ("é", ["été"], ["été"]),
        ("a\\", ["a\\b"], ["a\\b"]),
    ],
)
def test_prefix(spark, prefix, plain, corrected):
    values = ["Foo", "foobar", "FO_x", "été", "Été", "a\\b", "bar"]
    for expected, options in ((plain, {}), (corrected, {"corrected": True})):
        hit = names.has_prefix(names.fold_name(F.col("v")), prefix, **options)
        assert [v for v, h in zip(values, column(spark, hit, values), strict=True) if h] == expected
        by_column = names.has_prefix(names.fold_name(F.col("v")), F.lit(prefix), **options)
        assert column(spark, by_column, values) == column(spark, hit, values)


def test_prefix_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("foo",)], "name_fold string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(names.has_prefix(F.col("name_fold"), "Fo"))
    assert "StringStartsWith(name_fold,fo)" in df._jdf.queryExecution().executedPlan().toString()


def test_workspace_index_prunes(spark, tmp_path):
    rows = [("w1", "a", "1"), ("w2", "b", "2")]
    tb.write_file_table(spark.createDataFrame(rows, "workspace string, path string, md5 string"), str(tmp_path / "f"))
    df = tb.read_workspace_index(spark, str(tmp_path / "f"), "w2")
    assert [r["path"] for r in df.collect()] == ["b"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(workspace" in plan


def test_fingerprint(spark, root):
    rows = fl.workspace_files(fl.scan_files(spark, root), "w", root).collect()
    assert {r["path"]: r["md5"] for r in rows if r["path"] in TREE} == {
        path: hashlib.md5(content).hexdigest() for path, content in TREE.items()
    }


def test_embedding_text(spark):
    values = [1.0, 0.5, -0.25, 1e-5, 1.5e-7, 0.0001, 123456789.0, 0.0, 3e21, 0.1, 1e20]
    df = spark.createDataFrame([(values,)], "e array<double>").select(tb.format_embedding(F.col("e")).alias("f"))
    row = df.first()["f"]
    assert row["vector"] == (
        "[1, 0.5, -0.25, 1e-05, 1.5e-07, 0.0001, 123456790, 0, 3e+21, 0.1, 100000000000000000000]"
    )
    assert row["dimensions"] == 11


def test_a_local_folder_is_listed_entry_by_entry(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text("x")
    (tmp_path / "_empty").write_text("")
    (tmp_path / "file_link").symlink_to(tmp_path / "a.py")
    (tmp_path / "folder_link").symlink_to(tmp_path / "sub")
    (tmp_path / "broken").symlink_to(tmp_path / "nowhere")
    os.mkfifo(tmp_path / "pipe")
    system, inner = fl.open_filesystem(str(tmp_path))
    entries = fl._entries(inner, system)
    assert iter(entries) is entries
    found = {path.removeprefix(f"{inner}/"): is_dir for path, is_dir in entries}
    assert found == {"sub": True, "a.py": False, "_empty": False, "file_link": False, "broken": False}


def test_symbols_are_extracted_once_for_their_table(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(number):
        calls.add(1)
        return f"n{number}"

    numbers = spark.range(50)
    symbols = numbers.select(F.lit("w").alias("workspace"), name.asNondeterministic()("id").alias("name_fold"), F.col("id").alias("symbol_id"))
    tb.write_symbol_table(symbols, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 50 and calls.value == 50
