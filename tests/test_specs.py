import random

import pytest
from pyspark.sql import functions as F

from symloom.functions import specs as sp
from symloom.operators import context as cx
from symloom.operators import symbols as sy

# Specs and the items they must give.
SPEC_CASES = [
    ("file.go", [(["file.go"], "file")]),
    ("file.go MyFunction", [(["file.go", "MyFunction"], "symbol")]),
    ("file.go 10:20", [(["file.go", "10:20"], "range")]),
    (
        "file.go MyFunction 10:20 AnotherSymbol",
        [(["file.go", "MyFunction", "10:20", "AnotherSymbol"], kind) for kind in ("symbol", "range", "symbol")],
    ),
    (
        "file1.go MyFunction\nfile2.go 10:20",
        [(["file1.go", "MyFunction"], "symbol"), (["file2.go", "10:20"], "range")],
    ),
    ("file.go 20:10", None),
    ('"my file.go" MyFunction', [(["my file.go", "MyFunction"], "symbol")]),
    ('"my file.go MyFunction', None),
]


def parsed(spark, specs):
    df = spark.createDataFrame(list(enumerate(specs)), "spec_id int, spec string")
    rows = cx.parse_context_specs(df).collect()
    return {
        number: sorted((r for r in rows if r["spec_id"] == number), key=lambda r: (r["line_no"] or 0, r["item_no"] or 0))
        for number in range(len(specs))
    }


def test_reference_spec_cases(spark):
    found = parsed(spark, [spec for spec, _ in SPEC_CASES])
    for number, (_, expected) in enumerate(SPEC_CASES):
        if expected is None:
            assert [r["error"] is not None for r in found[number]] == [True]
        else:
            assert [(r["parts"], r["type"]) for r in found[number]] == expected


def test_one_bad_line_fails_the_spec(spark):
    found = parsed(spark, ["a.go\nb.go 3:1\nc.go", "", "\n\n", "   \na.go", "a.go\r\nb.go x:y", "a.go +1:07"])
    assert [r["error"] for r in found[0]] == [sp.ERROR_RANGE]
    assert found[1] == [] and found[2] == []
    assert [r["error"] for r in found[3]] == [sp.ERROR_BLANK]
    assert [r["error"] for r in found[4]] == [sp.ERROR_RANGE]
    assert [(r["identifier"], r["range_start"], r["range_end"]) for r in found[5]] == [("1:7", 1, 7)]


TOKEN_CASES = [
    ("", []),
    ("   ", []),
    ("a  b", ["a", "b"]),
    ('""', [""]),
    ('a "" b', ["a", "", "b"]),
    ('ab"c d"e', ["abc d", "e"]),
    ('"a""b"', ["a", "b"]),
    (r"a\ b", ["a b"]),
    (r"\\ x", ["\\", "x"]),
    (r'\"a b\"', ['"a', 'b"']),
    (r'"a\" b"', ['a" b']),
    ("a\\", ["a"]),
    ('a "b', None),
    ('"', None),
]


def spelled(rng):
    """A line made from tokens, each written plain, quoted, or plain with a quoted end."""
    tokens, line, apart = [], "", True
    for _ in range(rng.randint(0, 5)):
        plain = "".join(rng.choice("abé") for _ in range(rng.randint(0, 3)))
        odd = "".join(rng.choice('ab \\"é') for _ in range(rng.randint(0, 4)))
        escape = lambda text, marks: "".join("\\" + c if c in marks else c for c in text)
        kind = rng.choice(["plain", "quoted", "both"])
        if kind == "plain":
            token = plain + odd
            if not token:
                continue
            written = escape(token, '\\" ')
        else:
            token = (plain if kind == "both" else "") + odd
            written = (plain if kind == "both" else "") + '"' + escape(odd, '\\"') + '"'
        # A quote ends its token; a plain one lasts to the next blank.
        gap = " " * rng.randint(0 if apart else 1, 2)
        line += gap + written
        tokens.append(token)
        apart = kind != "plain"
    return line, tokens


def test_tokens(spark):
    rng = random.Random(3)
    cases = TOKEN_CASES + [spelled(rng) for _ in range(3000)]
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(cases)], "id int, line string")
    rows = df.select("id", sp.tokenize_spec_line(F.col("line")).alias("tokens")).collect()
    assert {r["id"]: r["tokens"] for r in rows} == {i: tokens for i, (_, tokens) in enumerate(cases)}


def test_long_token(spark):
    line = '"' + "x" * 200000 + '" ' + "y\\ " * 20000
    tokens = spark.createDataFrame([(line,)], "l string").select(sp.tokenize_spec_line(F.col("l"))).first()[0]
    assert tokens == ["x" * 200000, "y " * 20000]


@pytest.fixture(scope="module")
def workspace(spark):
    go = "package a\nfunc Foo() {\n\treturn\n}\nfunc FooBar() {\n}\n"
    files = spark.createDataFrame(
        [("w", "a.go", go), ("w", "sub/a.go", "x\nfunc Foo() {\n}\n"), ("w", "b.txt", "1\n2\n3\n4")],
        "workspace string, path string, text string",
    )
    return files, sy.symbol_table(sy.extract_symbols(files))


def contexts(spark, workspace, specs, **options):
    files, symbols = workspace
    df = spark.createDataFrame([(i, "w", s) for i, s in enumerate(specs)], "spec_id int, workspace string, spec string")
    items = cx.fetch_context_items(cx.parse_context_specs(df), symbols, files, **options)
    return {r["spec_id"]: r for r in cx.build_context(items, ["spec_id"]).collect()}


def test_build_context(spark, workspace):
    found = contexts(spark, workspace, ["b.txt 2:3\nb.txt", "a.go Foo", "b.txt\nnope.go", "a.go Missing", "b.txt 9:9"])
    assert found[0]["context"] == (
        '<FileRange\nfile="b.txt"\nrange="2:3"\n>\n2\n3\n</FileRange>\n<File\nfile="b.txt"\n>\n1\n2\n3\n4\n</File>\n'
    )
    assert found[1]["context"] == (
        '<FileSymbol\nfile="a.go"\nsymbol="Foo"\n>\nfunc Foo() {\n\treturn\n}\n</FileSymbol>\n'
    )
    assert [found[i]["error"] for i in (2, 3, 4)] == [cx.ERROR_NO_FILE, cx.ERROR_NO_SYMBOL, cx.ERROR_OUTSIDE]
    assert [found[i]["context"] for i in (2, 3, 4)] == [None] * 3


def test_symbol_text_comes_from_the_file_of_exactly_that_name(spark, workspace):
    files, symbols = workspace
    only_sub = symbols.where("path = 'sub/a.go'")
    wanted = spark.createDataFrame([("w", "a.go", "Foo")], "workspace string, filename string, identifier string")
    found = cx.lookup_symbol_text(only_sub, wanted, files).first()
    # sub/a.go ends with a.go, but the text is that of a.go: lines 1 to 3, the last one whole.
    assert found["content"] == "func Foo() {\n\treturn\n"


def test_all_hits_are_tried(spark):
    files = spark.createDataFrame(
        [("w", f"f{i:03}.py", "def run():\n  pass\n") for i in range(120)] + [("v", "f100.py", "def other(): pass\n")],
        "workspace string, path string, text string",
    )
    symbols = sy.symbol_table(sy.extract_symbols(files))
    asked = [("w", "f099.py", "run"), ("w", "f100.py", "run"), ("w", "100.py", "ru"), ("v", "f100.py", "run"), ("w", "", "run")]
    wanted = spark.createDataFrame(asked, "workspace string, filename string, identifier string")
    places = lambda **options: {
        (r["workspace"], r["filename"]) for r in cx.find_symbol_in_file(symbols, wanted, **options).collect()
    }
    assert places() == {("w", "f099.py"), ("w", "f100.py"), ("w", "100.py"), ("w", "")}
    assert places(limit=100) == {("w", "f099.py"), ("w", "")}
    found = cx.lookup_symbol_text(symbols, wanted.where("filename like 'f%'"), files).collect()
    assert {(r["workspace"], r["filename"]): r["error"] for r in found} == {
        ("w", "f099.py"): None, ("w", "f100.py"): None, ("v", "f100.py"): cx.ERROR_NO_SYMBOL,
    }


def test_a_context_of_many_pieces_gives_one_prompt(spark, workspace, monkeypatch):
    monkeypatch.setattr(cx, "ITEMS_PER_BLOCK", 1)
    files, symbols = workspace
    spec = "\n".join(["b.txt"] * 40)
    df = spark.createDataFrame([("w", spec)], "workspace string, spec string")
    items = cx.fetch_context_items(cx.parse_context_specs(df), symbols, files)
    contexts = cx.build_context(items, ["workspace"])
    whole = '<File\nfile="b.txt"\n>\n1\n2\n3\n4\n</File>\n' * 40
    assert [r["context"] for r in contexts.collect()] == [whole]
    selections = spark.createDataFrame([("w", "d", 0, 0, 0, 1)], "workspace string, path string, sl int, sc int, el int, ec int")
    documents = spark.createDataFrame([("w", "d", "abc")], "workspace string, path string, text string")
    prompts = cx.selection_prompt(selections, documents, contexts).collect()
    assert len(prompts) == 1 and prompts[0]["prompt"].startswith(whole + "<CurrentFile")


PROMPT = '<CurrentFile path="d">\n{}\n</CurrentFile>\n' + cx.SYSTEM_PROMPT + "<UserPrompt>\n{}\n</UserPrompt>\n"


@pytest.mark.parametrize(
    "place,plain,corrected",
    [
        ((0, 2, 2, 1), ("c\ndef", "c\ndef\ng"), ("abc\ndef", "c\ndef\ng")),
        ((1, 1, 1, 2), ("abc", "ef"), ("abc", "e")),
        ((1, 1, 1, 3), None, ("abc", "ef")),
        ((0, 9, 1, 0), None, None),
        ((2, 0, 1, 0), None, None),
        ((0, 0, 3, 0), ("abc\ndef\nghi", "abc\ndef\nghi\n"), ("abc\ndef\nghi", "abc\ndef\nghi\n")),
        ((0, 0, 4, 0), None, None),
    ],
)
def test_selection_prompt(spark, place, plain, corrected):
    documents = spark.createDataFrame([("w", "d", "abc\ndef\nghi")], "workspace string, path string, text string")
    selections = spark.createDataFrame([("w", "d", *place)], "workspace string, path string, sl int, sc int, el int, ec int")
    none = spark.createDataFrame([], "workspace string, context string, error string")
    for expected, options in ((plain, {}), (corrected, {"corrected": True})):
        row = cx.selection_prompt(selections, documents, none, **options).first()
        assert row["prompt"] == (None if expected is None else PROMPT.format(*expected))
        assert (row["error"] is None) == (expected is not None)


def test_prompt_needs_an_open_document_and_a_sound_context(spark):
    documents = spark.createDataFrame([("w", "d", "abc")], "workspace string, path string, text string")
    selections = spark.createDataFrame(
        [("w", "d", 0, 0, 0, 1), ("w", "x", 0, 0, 0, 1)], "workspace string, path string, sl int, sc int, el int, ec int"
    )
    broken = spark.createDataFrame([("w", None, "bad")], "workspace string, context string, error string")
    rows = cx.selection_prompt(selections, documents, broken).collect()
    assert {r["path"]: r["error"] for r in rows} == {"d": "bad", "x": "document not open"}


def test_documents_of_one_workspace_meet_its_context_in_shares(spark, monkeypatch):
    monkeypatch.setattr(cx, "TEXTS_PER_SALT", 10)
    plain = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    selections = spark.range(400).selectExpr("'w' AS workspace", "concat('p', id) AS path", "0 AS sl", "0 AS sc", "0 AS el", "1 AS ec")
    opened = selections.selectExpr("workspace", "path", "'text' AS text")
    contexts = spark.createDataFrame([("w", "ctx", None)], "workspace string, context string, error string")
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        prompts = cx.selection_prompt(selections, opened, contexts)
        per_task = [r["count"] for r in prompts.groupBy(F.spark_partition_id()).count().collect()]
        assert prompts.where("prompt like 'ctx%' AND error IS NULL").count() == 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(per_task) == 400 and max(per_task) < 200
