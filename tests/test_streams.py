import json

import pytest
from pyspark.sql import functions as F

from symloom.operators import events as ev
from symloom.operators.search import HashedWords
from symloom.streaming.completions import CompletionStream
from symloom.streaming.documents import DocumentStateStream
from symloom.streaming.refresh import MANIFEST, IndexRefreshStream

EVENT = "seq bigint, method string, params string, ts timestamp"


def message(spark, rows):
    import datetime

    stamp = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(s, m, p if isinstance(p, str) else json.dumps(p), stamp) for s, m, p in rows], EVENT)


def opened(uri, text, version=1):
    return {"textDocument": {"uri": uri, "languageId": "go", "version": version, "text": text}}


def changed(uri, *changes, version=2):
    return {
        "textDocument": {"uri": uri, "version": version},
        "contentChanges": [
            {"range": {"start": {"line": a, "character": b}, "end": {"line": c, "character": d}}, "text": t}
            for a, b, c, d, t in changes
        ],
    }


def closed(uri):
    return {"textDocument": {"uri": uri}}


BATCHES = [
    [
        (5, ev.CHANGE, changed("a", (0, 1, 0, 1, "X"))),
        (1, ev.OPEN, opened("a", "one\ntwo")),
        (2, ev.CHANGE, changed("a", (1, 0, 1, 3, "TWO"), (9, 0, 9, 0, "bad"))),
        (3, ev.OPEN, opened("b", "b")),
        (4, ev.CHANGE, changed("c", (0, 0, 0, 0, "x"))),
        (6, ev.CHANGE, "{broken"),
        (7, "initialized", "{}"),
    ],
    [
        (8, ev.CLOSE, closed("b")),
        (9, ev.CHANGE, changed("a", (0, 0, 1, 0, "n\n"))),
        (3, ev.CHANGE, changed("a", (0, 0, 0, 0, "late"))),
        (10, ev.OPEN, opened("c", "c1", 7)),
        (11, ev.CHANGE, changed("c", (0, 2, 0, 2, "\nend"))),
        (12, ev.CHANGE, changed("c", (1, 0, 1, 3, "END"))),
    ],
    [(13, ev.CHANGE, changed("b", (0, 0, 0, 0, "x"))), (14, ev.OPEN, opened("a", "fresh")), (15, ev.CLOSE, closed("c"))],
]

OPEN_AFTER = [
    {"a": "oXne\ntwo", "b": "b"},
    {"a": "n\ntwo", "c": "c1\nEND"},
    {"a": "fresh"},
]
PROBLEMS = {
    ("a", 2, "line out of bounds"),
    ("c", 4, "document not open"),
    (None, 6, "bad params"),
    ("a", 3, "late"),
    ("b", 13, "document not open"),
}


def feed(stream, folder, rows):
    """Rows arrive as one more file, and the stream takes in what is new."""
    rows.coalesce(1).write.mode("append").parquet(str(folder))
    stream.run(rows.sparkSession.readStream.schema(rows.schema).parquet(str(folder)))


def forget_commit(root, number):
    """As if the process ended after the output of a batch was written and before the batch was committed."""
    for path in (root / "checkpoint" / "commits").iterdir():
        if path.name.strip(".").split(".")[0] == str(number):
            path.unlink()


def test_document_stream(spark, tmp_path):
    for number, rows in enumerate(BATCHES):
        # Each batch is taken in by a new object: all that is known lies in the checkpoint.
        stream = DocumentStateStream(spark, str(tmp_path / "out"))
        assert number or (stream.documents().collect(), stream.problems().collect()) == ([], [])
        feed(stream, tmp_path / "in", message(spark, rows))
        found = {r["uri"]: r["text"] for r in stream.documents().where("is_open").collect()}
        assert found == OPEN_AFTER[number]
    problems = [(r["uri"], r["seq"], r["reason"]) for r in stream.problems().collect()]
    assert set(problems) == PROBLEMS and len(problems) == len(PROBLEMS)


def test_a_batch_that_was_not_committed_runs_again(spark, tmp_path):
    for number, rows in enumerate(BATCHES):
        stream = DocumentStateStream(spark, str(tmp_path / "out"))
        feed(stream, tmp_path / "in", message(spark, rows))
        forget_commit(tmp_path / "out", number)
    stream = DocumentStateStream(spark, str(tmp_path / "out"))
    feed(stream, tmp_path / "in", message(spark, [(16, ev.OPEN, opened("z", "z"))]))
    states = {r["uri"]: (r["text"], r["last_seq"]) for r in stream.documents().where("is_open").collect()}
    assert states == {"a": ("fresh", 14), "z": ("z", 16)}
    assert len(stream.problems().collect()) == len(PROBLEMS)


def test_a_repeat_inside_a_batch_is_applied_once(spark, tmp_path):
    edit = (2, ev.CHANGE, changed("a", (0, 0, 0, 0, "X")))
    stream = DocumentStateStream(spark, str(tmp_path / "out"))
    rows = [(1, ev.OPEN, opened("a", "a")), edit, edit, (3, ev.CHANGE, "{x"), (3, ev.CHANGE, "{x"), (None, ev.CLOSE, closed("a"))]
    feed(stream, tmp_path / "in", message(spark, rows))
    assert [r["text"] for r in stream.documents().collect()] == ["Xa"]
    problems = sorted((r["uri"] or "", r["seq"] or 0, r["reason"]) for r in stream.problems().collect())
    assert problems == [("", 3, "bad params"), ("", 3, "bad params"), ("a", 0, "no seq"), ("a", 2, "late")]


@pytest.mark.parametrize(("corrected", "expected"), [(False, (4, 0)), (True, (5, 2))])
def test_edits_leave_version_and_time_alone(spark, tmp_path, corrected, expected):
    rows = [(1, ev.OPEN, opened("a", "x", 4)), (2, ev.CHANGE, changed("a", (0, 0, 0, 0, "1\n2\n"), version=5))]
    stream = DocumentStateStream(spark, str(tmp_path / "out"), corrected=corrected)
    feed(stream, tmp_path / "in", message(spark, rows))
    row = stream.documents().first()
    assert (row["version"], row["last_edited_line"]) == expected


def test_one_document_with_most_events(spark, tmp_path):
    rows = [(0, ev.OPEN, opened("hot", ""))]
    rows += [(n, ev.CHANGE, changed("hot", (0, 0, 0, 0, f"{n}\n"))) for n in range(1, 1500)]
    rows += [(1500 + n, ev.OPEN, opened(f"u{n}", "x")) for n in range(300)]
    stream = DocumentStateStream(spark, str(tmp_path / "out"))
    feed(stream, tmp_path / "in", message(spark, rows))
    texts = {r["uri"]: r["text"] for r in stream.documents().collect()}
    assert texts["hot"] == "".join(f"{n}\n" for n in range(1499, 0, -1)) and len(texts) == 301


def test_closed_documents_can_be_forgotten(spark, tmp_path):
    stream = DocumentStateStream(spark, str(tmp_path / "out"), forget_after_ms=1)
    feed(stream, tmp_path / "in", message(spark, [(1, ev.OPEN, opened("a", "a")), (2, ev.OPEN, opened("b", "b")), (3, ev.CLOSE, closed("a"))]))
    feed(stream, tmp_path / "in", message(spark, [(4, ev.OPEN, opened("c", "c"))]))
    assert {r["uri"] for r in stream.documents().collect()} == {"b", "c"}
    feed(stream, tmp_path / "in", message(spark, [(1, ev.OPEN, opened("a", "again"))]))
    assert {r["uri"]: r["text"] for r in stream.documents().collect()} == {"a": "again", "b": "b", "c": "c"}


def test_parse_event_json(spark):
    rows = [
        (1, ev.OPEN, opened("a", "t")),
        (2, "workspace/symbol", {"query": "Foo"}),
        (3, "textDocument/codeAction", {"textDocument": {"uri": "a"}, "range": {"start": {"line": 1, "character": 2}, "end": {"line": 3, "character": 4}}}),
        (4, "workspace/executeCommand", {"command": "run", "arguments": [{"a": 1}]}),
        (5, ev.CHANGE, "[1]"),
        (6, "shutdown", "not json"),
        (7, ev.CHANGE, {"textDocument": {"uri": "a"}, "contentChanges": [{"text": "whole"}]}),
    ]
    found = {r["seq"]: r for r in ev.parse_event_json(message(spark, rows)).collect()}
    assert (found[1]["uri"], found[1]["language_id"], found[1]["text"]) == ("a", "go", "t")
    assert found[2]["query"] == "Foo"
    assert [found[3][c] for c in ("sl", "sc", "el", "ec")] == [1, 2, 3, 4]
    assert found[4]["command"] == "run" and found[4]["arguments"] == ['{"a":1}']
    assert found[5]["error"] == "bad params" and found[6]["error"] is None
    assert tuple(found[7]["changes"][0]) == (None, None, None, None, "whole")


CHUNK = "stream_id bigint, seq bigint, text string, done boolean"


def test_completion_stream(spark, tmp_path):
    batches = [
        [(1, 1, "ab", False), (1, 2, "c\nd", False), (2, 1, "x", True), (4, 0, "a", False), (4, 0, "b", False)],
        [(1, 2, "again", False), (1, 3, "e", False), (2, 2, "after done", False), (3, 5, "q\nr\ns", None)],
        [(1, 4, "\n\n", True), (3, 6, "t\n", False), (4, 1, "c", True), (4, 2, "after", True), (1, 5, "end", False)],
    ]
    for number, rows in enumerate(batches):
        stream = CompletionStream(spark, str(tmp_path / "out"), prefix="> ")
        feed(stream, tmp_path / "in", spark.createDataFrame(rows, CHUNK))
        if number < 2:
            forget_commit(tmp_path / "out", number)
    reports = [(r["stream_id"], r["seq"], r["message"]) for r in stream.reports().collect()]
    assert sorted(reports) == [(1, 2, "> abc"), (1, 4, "> de"), (3, 5, "> q"), (3, 6, "> r\nst")]
    assert sorted((r["stream_id"], r["seq"], r["text"]) for r in stream.late().collect()) == [
        (1, 2, "again"), (1, 5, "end"), (2, 2, "after done"), (4, 0, "b"), (4, 2, "after"),
    ]
    texts = {r["stream_id"]: r["full_text"] for r in stream.full_text().collect()}
    assert texts == {1: "abc\nde\n\n", 2: "x", 3: "q\nr\nst\n", 4: "ac"}
    edits = {(r["stream_id"], r["seq"]): (r["insert_line"], r["insert_character"]) for r in stream.edits().collect()}
    assert edits == {(1, 1): (0, 0), (1, 2): (0, 2), (1, 3): (1, 1), (1, 4): (1, 2), (2, 1): (0, 0), (3, 5): (0, 0), (3, 6): (2, 1), (4, 0): (0, 0), (4, 1): (0, 1)}
    states = {r["stream_id"]: (r["line"], r["character"], r["is_done"]) for r in stream.cursors().collect()}
    assert states == {1: (3, 0, True), 2: (0, 1, True), 3: (3, 0, False), 4: (0, 2, True)}
    assert {r["stream_id"]: r["pending"] for r in stream.pending().collect()} == {1: "\n", 2: "x", 3: "", 4: "ac"}


def test_pending_text_is_written_once(spark, tmp_path):
    stream = CompletionStream(spark, str(tmp_path / "out"), forget_after_ms=1)
    for number in range(3):
        rows = [(1, 2 * number + k, f"p{2 * number + k}", False) for k in (0, 1)] + [(2, number, f"{number}\n", number == 2)]
        feed(stream, tmp_path / "in", spark.createDataFrame(rows, CHUNK))
    pieces = stream._stream.variable("pieces", "").where("stream_id = 1")
    assert sorted(r["piece"] for r in pieces.collect()) == [f"p{n}" for n in range(6)]
    assert {r["stream_id"]: r["pending"] for r in stream.pending().collect()} == {1: "p0p1p2p3p4p5", 2: ""}
    feed(stream, tmp_path / "in", spark.createDataFrame([(1, 9, "!\n", True)], CHUNK))
    assert [r["message"] for r in stream.reports().where("stream_id = 1").collect()] == ["p0p1p2p3p4p5!"]
    # The stream that was done before is no longer in the state.
    assert {r["stream_id"] for r in stream.cursors().collect()} == {1}


def test_index_refresh(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    index = IndexRefreshStream(spark, str(tmp_path / "index"), vacuum_every=2)

    def arrive(batch_id, **texts):
        for name, text in texts.items():
            (root / f"{name}.py").write_text(text)
        rows = [("w", str(root), str(root / f"{name}.py")) for name in texts] + [("w", str(root), str(root / "gone.py"))]
        for _ in range(2):
            index.process(spark.createDataFrame(rows, MANIFEST), batch_id)
        files = {r["path"]: r["indexed_at"] for r in index.files().collect()}
        return files, sorted((r["path"], r["name"]) for r in index.symbols().collect())

    assert arrive(0, a="def f(): pass\ndef g(): pass\n", b="class B: pass\n") == (
        {"a.py": 0, "b.py": 0},
        [("a.py", "f"), ("a.py", "g"), ("b.py", "B")],
    )
    assert arrive(1, a="def h(): pass\n", b="class B: pass\n") == (
        {"a.py": 1, "b.py": 0},
        [("a.py", "h"), ("b.py", "B")],
    )
    assert arrive(2, a="x = 1\n", c="def f(): pass\n") == (
        {"a.py": 2, "b.py": 0, "c.py": 2},
        [("b.py", "B"), ("c.py", "f")],
    )


def test_failures_of_a_refresh_are_kept(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f(): pass\n")
    (tmp_path / "b.py").write_text("def g(): \0pass\n")
    rows = [("w", str(tmp_path), str(tmp_path / name)) for name in ("a.py", "b.py", "gone.py")]
    index = IndexRefreshStream(spark, str(tmp_path / "index"), model=HashedWords())
    index.process(spark.createDataFrame(rows, MANIFEST), 0)
    problems = lambda: {r["path"]: r["error"] for r in index.problems().collect()}
    assert problems().keys() == {"b.py", "gone.py"} and problems()["b.py"] == "not a text file"
    (tmp_path / "b.py").write_text("def g(): pass\n")
    index.process(spark.createDataFrame(rows, MANIFEST), 1)
    assert problems().keys() == {"gone.py"}
    assert {r["path"] for r in index.symbols().collect()} == {"a.py", "b.py"}
    vectors = index.embeddings().collect()
    assert len(vectors) == 2 and all(len(r["embedding"]) == 64 for r in vectors)


def test_notifications(spark):
    df = spark.createDataFrame([(m,) for m in [*ev.NOTIFICATION_METHODS, "shutdown", "workspace/symbol"]], "method string")
    one_way, two_way = ev.notification_filter(df)
    assert one_way.count() == 16 and two_way.count() == 2


def test_fingerprint_of_an_event(spark):
    row = ev.event_fingerprint(message(spark, [(1, "m", "abc")])).select("request_hash", F.col("request_timestamp")).first()
    assert row["request_hash"] == "a9993e364706816aba3e25717850c26c9cd0d89d"
    assert row["request_timestamp"] == 1704067200 * 10**9
