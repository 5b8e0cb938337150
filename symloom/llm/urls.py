"""URL filters: rules first, then host words by unigram Viterbi and a multinomial naive Bayes over the words."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.shared import free_name, least_of_top, most_frequent, stored, text_batches

#: Words, tokens and names that travel to all tasks at most, the most frequent of all; the others are joined.
VOCABULARY = 50_000
#: What a word of the pages and a name of an url consist of: letters of any script, and marks on them.
LETTERS = r"\p{L}\p{M}"
NAMES = rf"[{LETTERS}]+|[0-9]+|[^\x00-\x7F{LETTERS}]+"
#: Weights are summed as multiples of this part of one, so that the order of a sum does not matter.
PART = 1 << 32
#: Characters of probed words in one batch.
PROBED_AT_ONCE = 1 << 22

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lowered, after the first ``://`` up to ``/``, ``?`` or ``#``, and the path up to ``?`` or ``#``.

    Both are empty for a null url or one without ``://``.
    """
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules ``host/path`` that fits the host or a domain above it and the start of the path; else null."""
    fitting = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + start)
        fitting = F.when(fits, F.lit(rule)).otherwise(fitting)
    return fitting


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """``(word, count)`` of all words in all visible text of html, stored whole."""
    visible = F.regexp_replace(F.col(column), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&\w+;", " ")
    words = texts.where(F.col(column).isNotNull()).select(F.explode(F.split(F.lower(visible), f"[^{LETTERS}]+")).alias("word"))
    return stored(words.where("word <> ''").groupBy("word").count(), "url-words")


def segment(name: str, costs: dict[str, float], unknown: float) -> list[str]:
    """The cheapest split of a name into words; a piece that is no known word costs ``unknown`` and more by its length."""
    lengths = sorted({len(w) for w in costs}, reverse=True)
    best, back = [0.0], [0]
    # Of all unknown pieces that end somewhere, the one with the least cost before its start and most characters is cheapest.
    least, origin = 0.0, 0
    for end in range(1, len(name) + 1):
        if best[end - 1] - 2.3 * (end - 1) < least:
            least, origin = best[end - 1] - 2.3 * (end - 1), end - 1
        cheapest, start = least + unknown + 2.3 * end, origin
        for n in lengths:
            if n <= end:
                cost = best[end - n] + costs.get(name[end - n : end], math.inf)
                if cost < cheapest:
                    cheapest, start = cost, end - n
        best.append(cheapest)
        back.append(start)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def parts_of(name: str, lengths: Iterable[int]) -> Iterator[set[str]]:
    """All distinct parts of a name, for each of the lengths."""
    for n in lengths:
        if n <= len(name):
            yield {name[at : at + n] for at in range(len(name) - n + 1)}


def splits(names: DataFrame, counts: DataFrame, vocabulary: int) -> DataFrame:
    """``(name, words)`` of stored ``names (name, number)``, split by the unigram costs of all counted words.

    Costs are negative logarithms of frequency. The most frequent words travel to the tasks; every other part of a
    name, in a length that some word has, is looked up by a join, and a name gets the words that it holds.
    """
    context = names.sparkSession.sparkContext
    facts = counts.agg(F.sum("count"), F.min("count")).first()
    total, unknown = facts[0] or 1, math.log((facts[0] or 1) / (facts[1] or 1)) + 1 if facts[0] else 11.0
    lengths = sorted(r[0] for r in counts.select(F.length("word")).distinct().collect())
    top = {r["word"]: math.log(total / r["count"]) for r in most_frequent(counts, "word", "count", vocabulary)}
    sent = context.broadcast(top)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for name, number in zip(batch["name"], batch["number"], strict=True):
                for parts in parts_of(name, lengths):
                    rare = [(number, w) for w in parts if w not in sent.value]
                    rows += rare
                    size += sum(len(w) for _, w in rare)
                    if size > PROBED_AT_ONCE:
                        yield pd.DataFrame(rows, columns=["number", "word"])
                        rows, size = [], 0
        yield pd.DataFrame(rows, columns=["number", "word"])

    probes = names.select("name", "number").mapInPandas(probe, "number long, word string")
    held = probes.join(counts, "word").groupBy("number").agg(F.collect_list(F.struct("word", "count")).alias("rare"))

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series, rares: pd.Series) -> pd.Series:
        out = []
        for name, rare in zip(texts, rares, strict=True):
            costs = {w: sent.value[w] for parts in parts_of(name, lengths) for w in parts if w in sent.value}
            costs.update((r["word"], math.log(total / r["count"])) for r in (() if rare is None else rare))
            out.append(segment(name, costs, unknown))
        return pd.Series(out, dtype="object")

    return names.join(held, "number", "left").select("name", words("name", "rare").alias("words"))


def names_of(host: Column, path: Column) -> Column:
    """Names of the host and of the path as ``array<struct<mark, name>>``; digits count by their length."""

    def marked(mark: str, text: Column) -> Column:
        found = F.regexp_extract_all(F.lower(text), F.lit(NAMES), F.lit(0))
        digits = lambda n: F.concat(F.lit("#"), F.least(F.length(n), F.lit(9)).cast("string"))
        name = lambda n: F.when(n.rlike("^[0-9]"), digits(n)).otherwise(n)
        return F.transform(found, lambda n: F.struct(F.lit(mark).alias("mark"), name(n).alias("name")))

    return F.concat(marked("h:", host), marked("p:", path))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], number: str, limit: int) -> DataFrame:
    """The inner join of ``rows`` with a stored table of one row per key, whose ``number`` tells how often the key occurs.

    At most ``limit`` keys, the most frequent, are broadcast; the others meet by a shuffle.
    """
    least = least_of_top(table, number, limit)
    if least is None:
        return rows.join(table, keys)
    hot = F.broadcast(table.where(F.col(number) >= least))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(number) < least), keys)
    return rows.join(hot, keys).unionByName(cold)


def judged(
    pages: DataFrame, rules: dict[str, str], url_col: str = "url", html_col: str = "html", vocabulary: int = VOCABULARY,
    result: str = "_judged",
) -> DataFrame:
    """Add the struct ``result``: ``host, path, rule, verdict, odds``; other columns stay as they are.

    The longest rule that fits decides. For other urls a multinomial naive Bayes with add-one smoothing does, taught
    by all pages that a rule decides: ``block`` where the odds favour it, ``allow`` otherwise, also when no rule fits
    anywhere. Its tokens are the words that names of hosts and paths are split into, told apart by where they stand;
    those that no rule's page has do not count. A null url, or one without ``://``, has no token and gets the prior's
    verdict. Words come from the visible text of all pages; null html has none. Repeated rows count as often as they
    occur. An empty table gives no rows.

    All words and tokens count. Each distinct name is split and weighed once. ``vocabulary`` bounds what is broadcast of
    words, tokens and names, not what counts: the rest is joined. The odds join the pages by host and path.
    """
    counted = word_counts(text_batches(pages), html_col)
    host, path = host_and_path(F.col(url_col))
    rule = rule_for(host, path, rules)
    decided = F.lit(None).cast("string")
    for name, verdict in rules.items():
        decided = F.when(rule == name, F.lit(verdict)).otherwise(decided)
    allows, blocks = (F.coalesce((decided == v).cast("long"), F.lit(0).cast("long")) for v in (ALLOW, BLOCK))
    taught = pages.select(host.alias("host"), path.alias("path"), allows.alias("a"), blocks.alias("b"))
    sums = [F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")]
    urls = taught.groupBy("host", "path").agg(*sums).withColumn("url", F.monotonically_increasing_id())
    urls = stored(urls, "urls")
    pages_of = urls.agg(F.sum("a"), F.sum("b")).first()
    met = urls.select("url", "a", "b", "n", F.explode(names_of(F.col("host"), F.col("path"))).alias("_")).select("*", "_.*").drop("_")
    names = met.groupBy("mark", "name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    names = stored(names.withColumn("marked", F.monotonically_increasing_id()), "url-names")
    letters = F.col("name").rlike(f"^[{LETTERS}]")
    plain = stored(names.where(letters).select("name").distinct().withColumn("number", F.monotonically_increasing_id()), "url-plain")
    cut = names.where(letters).join(splits(plain, counted, vocabulary), "name")
    cut = cut.unionByName(names.where(~letters).withColumn("words", F.array("name")))
    tokens = cut.select("marked", "a", "b", "mark", F.explode("words").alias("word"))
    tokens = stored(tokens.select("marked", "a", "b", F.concat("mark", "word").alias("token")), "url-tokens")
    counts = stored(tokens.groupBy("token").agg(*sums).where("a + b > 0"), "url-counts")
    totals = counts.agg(F.sum("a"), F.sum("b"), F.count(F.lit(1))).first()
    size = totals[2] + 1
    weight = F.log((F.col("b") + 1) / F.lit(float((totals[1] or 0) + size))) - F.log((F.col("a") + 1) / F.lit(float((totals[0] or 0) + size)))
    weights = counts.select("token", "n", F.round(weight * PART).cast("long").alias("weight"))
    weighed = looked_up(tokens.select("marked", "token"), weights, ["token"], "n", vocabulary)
    by_name = names.join(weighed.groupBy("marked").agg(F.sum("weight").alias("weight")), "marked")
    by_name = stored(by_name.select("mark", "name", "n", "weight"), "url-weights")
    by_url = looked_up(met.select("url", "mark", "name"), by_name, ["mark", "name"], "n", vocabulary)
    odds = urls.join(by_url.groupBy("url").agg(F.sum("weight").alias("weight")), "url", "left")
    prior = round(math.log(((pages_of[1] or 0) + 1) / ((pages_of[0] or 0) + 1)) * PART)
    odds = stored(odds.select("host", "path", ((F.coalesce("weight", F.lit(0)) + prior) / float(PART)).alias("odds")), "url-odds")

    h, p, o = (free_name(pages, n) for n in ("_host", "_path", "_odds"))
    found = pages.withColumn(h, host).withColumn(p, path)
    found = found.join(odds.select(F.col("host").alias(h), F.col("path").alias(p), F.col("odds").alias(o)), [h, p], "left")
    verdict = F.coalesce(decided, F.when(F.col(o) > 0, BLOCK).otherwise(ALLOW))
    struct = F.struct(
        F.col(h).alias("host"), F.col(p).alias("path"), rule.alias("rule"), verdict.alias("verdict"), F.col(o).alias("odds")
    )
    return found.withColumn(result, struct).drop(h, p, o)
