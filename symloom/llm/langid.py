"""Language identification by rank-order profiles of n-grams and the out-of-place distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.shared import discard, free_name, kth_smallest, stored, text_batches

#: The n-grams of a profile, most frequent first.
PROFILE = 400
#: Labelled documents per language that profiles are made of, about, unless all of them are asked for.
TRAINING_ROWS = 4000
UNKNOWN = "und"
#: A document is in a known language when its score is at least this share of the score that all but ``OUTLIERS`` of
#: the training documents reach.
LEAST_SHARE, OUTLIERS = 0.5, 0.01

WORD = re.compile(r"[^\W\d_]+")


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-grams of a text's lower-cased words and their counts.

    A word's start and end count as a blank. A gram is coded by its characters, 21 bits each.
    """
    words = WORD.findall(text.lower())
    if not all(map(str.isalpha, words)):
        # Fractions, raised digits and number letters are no letters.
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = f" {' '.join(words)} "
    c = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = c != 32
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.unique(np.concatenate((c[letter], two, three[letter[1:-1]])), return_counts=True)


def top_grams(text: str) -> np.ndarray:
    """The document's profile: most frequent first, ties by code."""
    grams, counts = grams_of(text)
    return grams[np.lexsort((grams, -counts))[:PROFILE]]


class Profiles:
    """The ranks of all languages' n-grams in one table; a gram that a language lacks is out of place by a whole profile."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int64)
        for k, language in enumerate(self.languages):
            at = np.searchsorted(self.grams, np.array(profiles[language], np.int64))
            self.ranks[at, k] = np.arange(len(at))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and how near: 1 for the profile itself, 0 where no n-gram is shared."""
        mine = top_grams(text or "")
        if not len(mine) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, mine)
        at = np.where(self.grams[np.minimum(at, len(self.grams) - 1)] == mine, at, len(self.grams))
        ranks = self.ranks[at]
        places = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(mine))[:, None]))
        distance = places.sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best] / (PROFILE * len(mine)))


def held_out(id_col: str) -> Column:
    """Whether a document is kept from training: the checksum of its id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, id_col: str, lang_col: str) -> DataFrame:
    """All labelled documents that are not held out."""
    return text_batches(docs).where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))


def training_sample(docs: DataFrame, rows: int | None, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, list[str]]:
    """``(lang, text)`` of about ``rows`` training documents per language, or of all of them, and all languages."""
    usable = training_rows(docs, id_col, lang_col)
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    if rows is not None and counts:
        share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))])
        usable = usable.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30) < share[F.col(lang_col)])
    return usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), list(counts)


def learn_profiles(
    docs: DataFrame, rows: int | None = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Profiles:
    """Profiles from about ``rows`` labelled documents per language that are not held out, picked by a hash of the id; from all without ``rows``.

    N-grams are counted in the tasks and summed; the driver gets ``PROFILE`` n-grams per language.
    """
    sample, languages = training_sample(docs, rows, id_col, text_col, lang_col)
    if not languages:
        return Profiles({})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.dropna().groupby("lang")["text"]:
                found = [grams_of(t) for t in texts]
                grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64) if len(at) else []
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

    counted = stored(
        sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "grams",
    )
    best = {}
    for lang in languages:
        top = counted.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(PROFILE).collect()
        if top:
            best[lang] = [r["gram"] for r in top]
    return Profiles(best)


def predicted(docs: DataFrame, profiles: Profiles, text_col: str = "text", result: str = "_language") -> DataFrame:
    """Add the struct ``result`` of ``lang`` and ``score`` (0 to 1) to every row; other columns stay.

    A null text, or one without a letter, is ``und`` with score 0, as is every text when nothing was
    learned. Equal distances go to the first language in alphabetical order. Only the text counts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        known = sent.value
        return pd.DataFrame([known.predict(t) for t in texts], columns=["lang", "score"])

    # Not deterministic for the optimizer: a filter on the result must not run it once more.
    return text_batches(docs).withColumn(result, language.asNondeterministic()(F.col(text_col)))


def least_score(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """``LEAST_SHARE`` of the score that all but ``OUTLIERS`` of the training documents with a letter reach; 0 without any.

    Every training document is scored; the score lies between the two nearest ones in order, which counts in the tasks find.
    """
    scored = predicted(training_rows(docs, id_col, lang_col).select(F.col(text_col).alias("text")), profiles)
    scores = stored(scored.select("_language.*").where(F.col("lang") != UNKNOWN).select("score"), "scores")
    at = OUTLIERS * max(scores.count() - 1, 0)
    low, high = (kth_smallest(scores, "score", int(f(at))) or 0.0 for f in (np.floor, np.ceil))
    discard(scores)
    return LEAST_SHARE * float(low if low == high else (np.ceil(at) - at) * low + (at - np.floor(at)) * high)


def identified(docs: DataFrame, min_score: float | None = None, **columns: str) -> DataFrame:
    """The documents in a known language; their columns stay as they are.

    A text that shares no n-gram with any profile is in none, nor is one whose score is below ``min_score``, by
    default the ``least_score`` of the training documents. All of them make the profiles and the least score.
    """
    name = free_name(docs, "_language")
    profiles = learn_profiles(docs, None, **columns)
    least = least_score(docs, profiles, **columns) if min_score is None else min_score
    found = predicted(docs, profiles, columns.get("text_col", "text"), name)
    score = F.col(f"{name}.score")
    return found.where((F.col(f"{name}.lang") != UNKNOWN) & (score > 0) & (score >= least)).select(*docs.columns)
