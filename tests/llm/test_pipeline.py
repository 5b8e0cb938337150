"""The pipeline's stages on small tables: columns, decisions, and what must stay."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from symloom.llm import langid
from symloom.llm.queries import table


@pytest.fixture(scope="module")
def outputs(spark, small):
    docs, found = table(spark, small, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        found.append((name, docs.columns, [r.asDict() for r in docs.collect()]))
        docs = spark.createDataFrame(found[-1][2], docs.schema) if found[-1][2] else docs
    return found


def test_stages_keep_the_columns(spark, small, outputs):
    columns = table(spark, small, "documents").columns
    assert [name for name, _, _ in outputs][0] == "language_id" and len(outputs) == 5
    assert all(c == columns for _, c, _ in outputs[:-1])


def test_decisions_take_effect(outputs):
    by_stage = {name: rows for name, _, rows in outputs}
    languages = {r["doc_id"] for r in by_stage["language_id"]}
    assert not {1, 2, 3, 4} & languages and {5, 6, 12, 14, 60} <= languages
    unique = [r["doc_id"] for r in by_stage["simhash_near_dedup"]]
    assert unique.count(12) == 1 and not set(range(40, 46)) & set(unique) and None not in unique
    clean = {r["doc_id"]: r["text"] for r in by_stage["benchmark_decontamination"]}
    assert 5 not in clean and 6 not in clean
    shared = {r["doc_id"]: r["text"] for r in by_stage["simhash_near_dedup"]}[9].split()
    assert clean[9].split() == shared[:3] + shared[30:]
    covered = {r["doc_id"]: r for r in by_stage["secret_scan"]}
    assert "0123456789abcdef" not in covered[15]["text"] and "[secret]" in covered[15]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in covered.values())
    packed = by_stage["packing"]
    assert {r["doc_id"] for r in packed} == set(covered)


def test_clean_documents_stay_as_they_are(outputs, documents):
    texts = {i: t for i, t, _ in documents}
    kept = {r["doc_id"]: r["text"] for r in outputs[3][2]}
    for i in (14, 61, 70):
        if i in {r["doc_id"] for r in outputs[1][2]}:
            assert kept[i] == texts[i]


def test_run_gives_the_last_stage(spark, small, outputs):
    rows = [r.asDict() for r in corpus_pipeline.run(spark, small).collect()]
    pieces = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert pieces(rows) == pieces(outputs[4][2])


def test_empty_tables_pass_through(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).collect() == []


def test_unknown_languages_are_rejected(spark):
    rng = random.Random(2)
    text = lambda words: " ".join(rng.choices(words.split(), k=rng.randint(3, 60)))
    english, french = "the river and stone house with light winter", "la maison est près du jardin avec une fenêtre"
    rows = [(k, text(english if k % 2 else french), "en" if k % 2 else "fr") for k in range(400)]
    rows += [(1000, text("река и каменный дом зимой"), None), (1001, text("日本語 テキスト"), None), (1002, "qxzk " * 50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.unionByName(spark.createDataFrame([(2000, text(english), None), (2001, text(french), None)], docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == {*range(400), 2000, 2001}


def test_every_training_document_makes_the_profiles_and_the_least_score(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(400)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12))), "en") for k in range(2 * langid.TRAINING_ROWS)]
    docs = spark.createDataFrame([*rows, (None, "zzz", "en"), (-1, "zzz", None), (-2, None, "en")], "doc_id long, text string, lang string")
    texts = [t for k, t, _ in rows if zlib.crc32(str(k).encode()) % 5]
    assert len(texts) > langid.TRAINING_ROWS

    counts = Counter()
    for text in texts:
        counts.update(dict(zip(*map(np.ndarray.tolist, langid.grams_of(text)), strict=True)))
    profiles = langid.learn_profiles(docs, None)
    assert profiles.grams[np.argsort(profiles.ranks[:-1, 0])].tolist() == sorted(counts, key=lambda g: (-counts[g], g))[: langid.PROFILE]

    scores = [profiles.predict(t)[1] for t in texts]
    least = langid.least_score(docs, profiles)
    assert least == pytest.approx(0.5 * np.quantile(scores, 0.01), abs=1e-12)
    kept = {r["doc_id"] for r in langid.identified(docs).collect()}
    assert kept - {None, -1} == {k for k, t, _ in rows if profiles.predict(t)[1] >= least}
