import random

import pytest
from pyspark.sql import functions as F

from symloom import schemas
from symloom.functions import text as tx
from symloom.streaming.edit_fold import Buffer, EditError

# Edits and the texts they must give.
EDIT_CASES = [
    ("Hello\nWorld\n", [(0, 5, 0, 5, " there")], "Hello there\nWorld\n"),
    ("Hello\nWorld\n", [(1, 0, 1, 0, "\n")], "Hello\n\nWorld\n"),
    ("Line 1\nLine 2\nLine 3\n", [(0, 6, 2, 0, " modified\nNew")], "Line 1 modified\nNewLine 3\n"),
    ("Single line", [(1, 0, 1, 0, "This should fail")], None),
]


def random_batches(count, seed=7):
    rng = random.Random(seed)
    for _ in range(count):
        text = "\n".join(rng.choice(["", "a", "bc", "déf", "ghij k"]) for _ in range(rng.randint(1, 5)))
        yield text, [
            (rng.randint(0, 4), rng.randint(0, 5), rng.randint(0, 4), rng.randint(0, 4), rng.choice(["", "X", "Y\nZ", "\n"]))
            for _ in range(rng.randint(0, 4))
        ]


def edited(spark, cases, **options):
    rows = [(i, text, [tuple(e) for e in edits]) for i, (text, edits) in enumerate(cases)]
    edits = f"array<{schemas.EDIT.simpleString()}>"
    df = spark.createDataFrame(rows, f"id int, text string, edits {edits}")
    result = df.select("id", tx.apply_text_edits(F.col("text"), F.col("edits"), **options).alias("r"))
    return {row["id"]: row["r"] for row in result.collect()}


def test_reference_edit_cases(spark):
    results = edited(spark, [(text, edits) for text, edits, _ in EDIT_CASES])
    for number, (_, _, expected) in enumerate(EDIT_CASES):
        assert results[number]["text"] == expected
        assert (results[number]["error"] is not None) == (expected is None)


def place_of(text, offset):
    return text.count("\n", 0, offset), offset - (text.rfind("\n", 0, offset) + 1)


def test_a_splice_at_offsets_is_the_edit_at_their_places(spark):
    rng, cases, wanted = random.Random(5), [], []
    for _ in range(400):
        text = "".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 25)))
        start = rng.randint(0, len(text))
        end = rng.randint(start, len(text))
        new = rng.choice(["", "X", "Y\nZ", "\n"])
        cases.append((text, [(*place_of(text, start), *place_of(text, end), new)]))
        wanted.append(text[:start] + new + text[end:])
    results = edited(spark, cases)
    assert [results[i]["text"] for i in range(len(cases))] == wanted
    for (text, edits), after in zip(cases, wanted, strict=True):
        changes = [dict(zip(schemas.EDIT.names, edit, strict=True)) for edit in edits]
        buffer = Buffer(text).edited(changes, False)
        assert buffer.text == after and buffer.lengths == [len(line) for line in after.split("\n")]


@pytest.mark.parametrize("corrected", [False, True])
def test_streaming_fold_equals_the_column_fold(spark, corrected):
    cases = list(random_batches(200, seed=11))
    results = edited(spark, cases, corrected=corrected)
    for number, (text, edits) in enumerate(cases):
        rows = [dict(zip(schemas.EDIT.names, edit, strict=True)) for edit in edits]
        try:
            found = Buffer(text).edited(rows, corrected).text
        except EditError:
            found = None
        assert found == results[number]["text"]


def test_corrected_edits(spark):
    whole = (None, None, None, None, "all\nnew")
    results = edited(
        spark,
        [("abc\ndef", [whole]), ("abc", [(0, 1, 0, 99, "X")]), ("ab", [(0, 0, 0, 0, "x\n"), (1, 0, 1, 0, "y")])],
        corrected=True,
    )
    assert [results[i]["text"] for i in range(3)] == ["all\nnew", "aX", "x\nyab"]


def test_change_without_range_is_inserted_at_the_start(spark):
    assert edited(spark, [("abc", [(None, None, None, None, "X")])])[0]["text"] == "Xabc"


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "place,expected,corrected",
    [
        ((0, 1, 2, 2), "bc\ndef\ngh", "bc\ndef\ngh"),
        ((0, 1, 0, 2), "bc\nab", "b"),
        ((0, 3, 1, 0), "\n", "\n"),
        ((2, 1, 0, 2), "hi\nab", "hi\nab"),
        ((0, 4, 1, 0), None, None),
        ((0, 0, 3, 0), None, None),
        ((1, 0, 1, 4), None, None),
    ],
)
def test_slice_text_range(spark, place, expected, corrected):
    text = "abc\ndef\nghi"
    assert one(spark, tx.slice_text_range(F.col("text"), *place), text) == expected
    assert one(spark, tx.slice_text_range(F.col("text"), *place, corrected=True), text) == corrected


def test_slice_in_bytes(spark):
    text = "éab\nüxy"
    assert one(spark, tx.slice_text_range(F.col("text"), 0, 2, 1, 2, unit="byte"), text) == "ab\nü"
    assert one(spark, tx.slice_text_range(F.col("text"), 0, 2, 1, 2), text) == "b\nüx"


@pytest.mark.parametrize(
    "start,end,expected,corrected",
    [
        (1, 2, "a\nb", "a\nb"),
        (0, 1, "a", "a"),
        (-5, 2, "a\nb", "a\nb"),
        (2, 3, "b", "b\nc"),
        (1, 99, "a\nb", "a\nb\nc"),
        (3, 99, "", "c"),
        (4, 5, None, None),
        (1, -1, None, None),
    ],
)
def test_slice_line_range(spark, start, end, expected, corrected):
    assert one(spark, tx.slice_line_range(F.col("text"), start, end), "a\nb\nc") == expected
    assert one(spark, tx.slice_line_range(F.col("text"), start, end, corrected=True), "a\nb\nc") == corrected


@pytest.mark.parametrize("text,expected", [("", (0, 0)), ("ab", (0, 2)), ("a\nbcd", (1, 3)), ("é\n\n", (2, 0))])
def test_text_end_offset(spark, text, expected):
    assert tuple(one(spark, tx.text_end_offset(F.col("text")), text)) == expected


def test_text_end_offset_in_bytes(spark):
    assert one(spark, tx.text_end_offset(F.col("text"), "byte"), "x\néé")["character"] == 4
