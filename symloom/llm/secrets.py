"""Secret scans: patterns, and a character convolutional network over every candidate and its surroundings."""

from __future__ import annotations

import copy
import re
import string
import zlib
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.shared import kth_smallest, stored, text_batches

KINDS = ["assign", "access", "hex", "learned"]
PATTERNS = {
    "assign": re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    ),
    "access": re.compile(r"AKIA[A-Z0-9]{12,}"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
}
SHORTEST_VALUE = 8
#: The words by which the first pattern knows a value. The network never sees them: what it is asked about has none.
KEY_WORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
#: What the network looks at beside the patterns' findings: runs of key characters of this length or more.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

LEFT, HEAD, TAIL, RIGHT = 24, 32, 8, 16
WIDTH = HEAD + TAIL
WINDOW = LEFT + WIDTH + RIGHT
#: Over a candidate longer than ``WIDTH`` the window moves by this many characters; all of it is seen.
STEP = 8
#: Windows that are scored at once.
WINDOWS_AT_ONCE = 4096
#: Rows of each kind, found or not found by the patterns, that a first network learns from in one place: the lowest hashes.
#: Where a table has more, all of its rows train that network on, in blocks of ``ROWS_PER_BLOCK`` or more, and set the threshold.
TRAINING_ROWS = 3000
ROWS_PER_BLOCK = 1024
#: The driver gets a network from each block, so there are no more blocks than these.
MOST_BLOCKS = 256
#: Step sizes of the rounds over all rows.
RATES = [0.004, 0.003, 0.002, 0.001]
#: The share of held-out findings that the threshold must let through.
RECALL = 0.99
#: Values made by a rule, of each kind, that are added to the training rows, a fifth of them held out as well.
MADE_ROWS = 3000
MADE_ALPHABETS = [
    "0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567",
    string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/",
]
#: Whole words of letters: those of the surroundings stand in made runs.
WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]{2,12}(?![A-Za-z])")
MADE_LENGTHS = [20, 24, 32, 40]
#: How syllables of made words begin, what vowels they have, and how they end.
ONSETS = "b c d f g h j k l m n p r s t v w z br ch dr fl gr kl pf ph pr qu sch sh sp st th tr".split()
VOWELS = "a e i o u y ai au ea ee ei ie io ou".split()
CODAS = ["", "", "", *"l m n r s t ch ff ft gs ht ll mp ng ns nt rt ss st ts".split()]

SYMBOLS = {c: k for k, c in enumerate(string.ascii_letters + string.digits + "+/_.=-\"': \n", 2)}
CODES = len(SYMBOLS) + 2


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the patterns' findings, in code points, by start and then by kind."""
    found = []
    for order, kind in enumerate(KINDS[:3]):
        for m in PATTERNS[kind].finditer(text):
            if kind != "assign" or len(m.group(2)) >= SHORTEST_VALUE:
                found.append((m.start(), order, m.end()))
    return [(start, end, KINDS[order]) for start, order, end in sorted(found)]


def framed(left: str, value: str, right: str) -> str:
    """A value between what stands before and after it, each cut or filled to its width."""
    return left[-LEFT:].rjust(LEFT, "\0") + value + right[:RIGHT].ljust(RIGHT, "\0")


def surroundings(text: str, start: int, end: int) -> str:
    """A candidate in its surroundings, without the pattern's key words.

    An assignment that begins with the candidate, as in ``password=...``, is cut to its value.
    """
    assign = PATTERNS["assign"].match(text, start, end)
    value = assign.start(2) if assign else start
    left, right = (KEY_WORD.sub("", side) for side in (text[max(0, start - 2 * LEFT) : value], text[end : end + 2 * RIGHT]))
    return framed(left, text[value:end], right)


def window_starts(around: str) -> Sequence[int]:
    """Where the windows over a candidate start: every ``STEP`` characters, and one at its end."""
    last = max(0, len(around) - WINDOW)
    return [*range(0, last, STEP), last]


def window_at(around: str, start: int) -> str:
    """One window of a candidate in its surroundings; a short candidate is filled between its head and its tail."""
    short = WINDOW - len(around)
    if short <= 0:
        return around[start : start + WINDOW]
    end = len(around) - RIGHT
    middle = min(LEFT + HEAD, end)
    return around[:middle].ljust(LEFT + HEAD, "\0") + around[middle:end].rjust(TAIL, "\0") + around[end:]


def drawn_window(around: str) -> str:
    """The window that stands for a candidate in the training sample, drawn by its checksum."""
    starts = window_starts(around)
    return window_at(around, starts[zlib.crc32(around.encode("utf-8", "surrogatepass")) % len(starts)])


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int, str]]:
    """``(start, end, label, surroundings)``: runs of key characters, cut where the patterns' findings start and end.

    What lies in findings has label 1, what is left of a run label 0. Parts too short for a value are left out.
    """
    covered: list[list[int]] = []
    for a, b, _ in base:
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    parts, at = [], 0
    for m in CANDIDATE.finditer(text):
        place, end = m.span()
        while at < len(covered) and covered[at][1] <= place:
            at += 1
        for k in range(at, len(covered)):
            a, b = max(covered[k][0], place), min(covered[k][1], end)
            if a >= end:
                break
            parts += [(place, a, 0), (a, b, 1)]
            place = b
        parts.append((place, end, 0))
    return [(a, b, label, surroundings(text, a, b)) for a, b, label in parts if b - a >= SHORTEST_VALUE]


def made_values(
    rng: np.random.Generator, rows: int, known: list[str] = ()
) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """Keys of random characters, ordinary runs of digits and of words, and prose around them.

    Half of the words are known ones, where there are any; the others are made of syllables and need no table.
    """

    def drawn(letters: str, size: int) -> str:
        return "".join(letters[k] for k in rng.integers(0, len(letters), size))

    def word() -> str:
        if known and rng.integers(0, 2):
            return known[rng.integers(0, len(known))]
        return "".join(part[rng.integers(0, len(part))] for _ in range(rng.integers(2, 5)) for part in (ONSETS, VOWELS, CODAS))

    def run() -> str:
        kind = int(rng.integers(0, 4))
        if kind == 0:
            return drawn(string.digits, int(rng.integers(8, 24)))
        words = [word() for _ in range(rng.integers(3, 6))]
        case = int(rng.integers(0, 4))
        if case < 2:
            words = [w.upper() if case else w.capitalize() for w in words]
        return ("" if kind == 1 else "-_/"[rng.integers(0, 3)]).join(words)

    keys = [drawn(MADE_ALPHABETS[k % len(MADE_ALPHABETS)], int(rng.choice(MADE_LENGTHS))) for k in range(rows)]
    sides = [(" ".join(word() for _ in range(4)) + " ", " " + " ".join(word() for _ in range(rng.integers(0, 4)))) for _ in range(rows)]
    return keys, [run() for _ in range(rows)], sides


def made_windows(windows: list[str], rows: int = MADE_ROWS, seed: int = 13) -> tuple[list[str], list[str]]:
    """Windows of made keys and of made ordinary runs, by turns in made prose and in the surroundings of given windows."""
    rng = np.random.default_rng(seed)
    known = [word for w in windows for side in (w[:LEFT], w[LEFT + WIDTH :]) for word in WORD.findall(side)]
    keys, runs, sides = made_values(rng, rows, known)
    for k, at in enumerate(rng.integers(0, len(windows), rows) if windows else ()):
        if k % 2:
            sides[k] = windows[at][:LEFT].strip("\0"), windows[at][LEFT + WIDTH :].strip("\0")
    return tuple([drawn_window(framed(left, v, right)) for v, (left, right) in zip(values, sides, strict=True)] for values in (keys, runs))


def coded(windows: list[str]) -> np.ndarray:
    """Character codes of windows: 0 fills, 1 stands for all characters without a code."""
    out = np.zeros((len(windows), WINDOW), np.int64)
    for k, w in enumerate(windows):
        out[k] = [0 if c == "\0" else SYMBOLS.get(c, 1) for c in w]
    return out


class Network:
    """Embedding, one convolution, the largest response of each filter in the candidate and around it, its mean in it, one output."""

    def __init__(self, seed: int = 7, width: int = 8, filters: int = 24, span: int = 5):
        rng = np.random.default_rng(seed)
        self.span = span
        self.weights = {
            "embed": rng.normal(0, 0.3, (CODES, width)),
            "conv": rng.normal(0, 0.3, (span * width, filters)),
            "shift": np.zeros(filters),
            "out": rng.normal(0, 0.3, 3 * filters),
            "bias": np.zeros(1),
        }
        self.slope, self.offset, self.threshold = 1.0, 0.0, 1.0
        places = np.arange(WINDOW - span + 1)
        self.inside = (places >= LEFT) & (places < LEFT + HEAD + TAIL - span + 1)

    def _forward(self, x: np.ndarray) -> tuple:
        w = self.weights
        embedded = w["embed"][x]
        columns = np.lib.stride_tricks.sliding_window_view(embedded, self.span, axis=1)
        columns = columns.transpose(0, 1, 3, 2).reshape(len(x), len(self.inside), -1)
        response = np.maximum(columns @ w["conv"] + w["shift"], 0)
        parts = [np.where(side[None, :, None], response, -1.0) for side in (self.inside, ~self.inside)]
        at = [p.argmax(axis=1) for p in parts]
        largest = [np.take_along_axis(response, a[:, None, :], axis=1)[:, 0] for a in at]
        pooled = np.concatenate([*largest, response[:, self.inside].mean(axis=1)], axis=1)
        return columns, response, at, pooled, pooled @ w["out"] + w["bias"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[a : a + 512])[-1] for a in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def _gradients(self, x: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        w, rows = self.weights, np.arange(len(x))[:, None]
        columns, response, at, pooled, logit = self._forward(x)
        error = (1 / (1 + np.exp(-logit)) - y) * importance / len(x)
        into = error[:, None] * w["out"][None, :]
        grads = {"out": pooled.T @ error, "bias": error.sum(keepdims=True)}
        filters = w["shift"].size
        back = np.zeros_like(response)
        for side, places in enumerate(at):
            share = into[:, side * filters : (side + 1) * filters]
            np.add.at(back, (rows, places, np.arange(filters)[None, :]), share)
        back[:, self.inside] += into[:, None, 2 * filters :] / self.inside.sum()
        back *= response > 0
        grads["shift"] = back.sum(axis=(0, 1))
        grads["conv"] = np.tensordot(columns, back, axes=([0, 1], [0, 1]))
        to_columns = (back @ w["conv"].T).reshape(*back.shape[:2], self.span, -1)
        grads["embed"] = np.zeros_like(w["embed"])
        for k in range(self.span):
            np.add.at(grads["embed"], x[:, k : k + back.shape[1]], to_columns[:, :, k])
        return grads

    def train(
        self, x: np.ndarray, y: np.ndarray, epochs: int = 20, batch: int = 64, rate: float = 0.01, weight: np.ndarray | None = None
    ) -> None:
        """Adam over shuffled batches, in smaller and smaller steps; both kinds weigh the same where no weights are given."""
        rng = np.random.default_rng(11)
        if weight is None:
            weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                chosen = order[at : at + batch]
                step += 1
                for name, grad in self._gradients(x[chosen], y[chosen], weight[chosen]).items():
                    first[name] = 0.9 * first[name] + 0.1 * grad
                    second[name] = 0.999 * second[name] + 0.001 * grad * grad
                    scale = np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8
                    self.weights[name] = self.weights[name] - rate * (1 - step / (steps + 1)) * first[name] / (1 - 0.9**step) / scale

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Fit a logistic curve to held-out logits, then set a threshold that lets ``recall`` of the findings through.

        The highest such threshold is moved half way towards the others below it, as none lies between. It is
        never under one half: what is more likely no secret is not reported.
        """
        logit = self.logits(x)
        slope, offset = 1.0, 0.0
        for _ in range(2000):
            p = 1 / (1 + np.exp(-(slope * logit + offset)))
            slope -= 0.05 * (((p - y) * logit).mean() + 0.01 * (slope - 1))
            offset -= 0.05 * ((p - y).mean() + 0.01 * offset)
        self.slope, self.offset = max(slope, 0.05), offset
        found = np.sort(self.probabilities(x[y == 1]))
        if not len(found):
            self.threshold = 1.1
            return
        highest = float(found[int(np.floor(len(found) * (1 - recall)))])
        others = self.probabilities(x[y == 0])
        below = float(others[others < highest].max(initial=0.0))
        self.threshold = max(0.5, (highest + below) / 2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(x) + self.offset)))

    def picks(self, arounds: list[str]) -> list[bool]:
        """Whether the likeliest of each candidate's windows reaches the threshold."""
        best = np.zeros(len(arounds))
        windows = ((k, window_at(around, at)) for k, around in enumerate(arounds) for at in window_starts(around))
        while part := list(islice(windows, WINDOWS_AT_ONCE)):
            np.maximum.at(best, [k for k, _ in part], self.probabilities(coded([w for _, w in part])))
        return (best >= self.threshold).tolist()


SCAN = "base array<struct<start: int, end: int, kind: string>>, found array<struct<start: int, end: int, label: int, around: string>>"


def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base = base_findings(text)
        rows.append((base, candidates(text, base)))
    return pd.DataFrame(rows, columns=["base", "found"])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, found)`` of every row: findings of the patterns and all candidates. A null text is empty."""
    scan = F.pandas_udf(_scan, SCAN).asNondeterministic()(F.coalesce(F.col(text_col), F.lit("")))
    return text_batches(docs).select(F.col(id_col).alias("id"), scan.alias("_scan")).select("id", "_scan.base", "_scan.found")


def fitted(found: list[tuple[str, bool]], unlabelled: list[tuple[str, bool]]) -> Network:
    """A network from ``(window, held out)`` of findings and of candidates that the patterns leave.

    Made keys join the findings, made runs the others, both between the surroundings of the candidates, so that surroundings
    alone tell nothing and a table with few findings or none has a network too. What the patterns leave is not
    known to be harmless: a first network, which learns to tell it from findings, names those that look as much like
    findings as the held-out findings do, and the second network learns without them.
    """
    keys, runs = made_windows([w for w, _ in unlabelled or found])
    held_out = [k % 5 == 0 for k in range(MADE_ROWS)]
    one, other = found + list(zip(keys, held_out, strict=True)), unlabelled + list(zip(runs, held_out, strict=True))
    x = coded([w for w, _ in one + other])
    y, held = np.repeat([1.0, 0.0], [len(one), len(other)]), np.array([h for _, h in one + other])
    network = Network()
    network.train(x[~held], y[~held])
    network.calibrate(x[held], y[held])
    doubted = np.zeros(len(x), bool)
    at = slice(len(one), len(one) + len(unlabelled))
    doubted[at] = network.probabilities(x[at]) >= network.threshold
    if doubted.any():
        network = Network()
        network.train(x[~held & ~doubted], y[~held & ~doubted])
        network.calibrate(x[held & ~doubted], y[held & ~doubted])
    return network


def weighted(rows: DataFrame) -> DataFrame:
    """``rows(label, made, ...)`` with weights of mean 1: both labels weigh the same, and in a label the table's rows and the made ones."""
    counts = {(r["label"], r["made"]): r["count"] for r in rows.groupBy("label", "made").count().collect()}
    weight = F.lit(None).cast("double")
    for (label, made), n in counts.items():
        share = sum(counts.values()) / n / sum(1 for k in counts if k[0] == label) / len({k[0] for k in counts})
        weight = F.when((F.col("label") == label) & (F.col("made") == made), F.lit(share)).otherwise(weight)
    return rows.withColumn("weight", weight)


def trained_in_blocks(rows: DataFrame, network: Network, rate: float) -> Network:
    """One round over ``rows(block, window, label, weight)``: every block trains the network on, and the mean of the results is next.

    The driver gets a network of each block, and no row.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("window")
        local = copy.deepcopy(network)
        local.train(coded(part["window"].tolist()), part["label"].to_numpy(float), 1, rate=rate, weight=part["weight"].to_numpy(float))
        flat = np.concatenate([local.weights[k].ravel() for k in sorted(local.weights)])
        return pd.DataFrame({"block": [part["block"].iloc[0]], "n": [len(part)], "flat": [flat]})

    made = sorted(rows.groupBy("block").applyInPandas(one, "block int, n long, flat array<double>").collect())
    mean = np.average([r["flat"] for r in made], axis=0, weights=[r["n"] for r in made])
    after, at = copy.deepcopy(network), 0
    for k in sorted(after.weights):
        size = after.weights[k].size
        after.weights[k] = mean[at : at + size].reshape(after.weights[k].shape)
        at += size
    return after


def scored(rows: DataFrame, network: Network) -> DataFrame:
    """The rows with the network's ``logit`` of their window, stored."""

    @F.pandas_udf("double")
    def logit(windows: pd.Series) -> pd.Series:
        return pd.Series(network.logits(coded(windows.tolist())))

    return stored(rows.withColumn("logit", logit("window")), "logits")


def calibrated_on_all(held: DataFrame, network: Network, recall: float = RECALL) -> Network:
    """``Network.calibrate`` by sums and counts over ``held(logit, label, made)`` of any size.

    The threshold lets ``recall`` of the table's findings through, and of the made keys as well.
    """
    held, logit, after = weighted(held), F.col("logit"), copy.deepcopy(network)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + F.exp(-(logit * a + b)))
        error, curve = F.col("weight") * (p - F.col("label")), F.col("weight") * p * (1 - p)
        sums = held.agg(F.sum("weight"), *[F.sum(c) for c in (error * logit, error, curve * logit * logit, curve * logit, curve)]).first()
        ga, gb, haa, hab, hbb = (s / sums[0] for s in sums[1:])
        gradient = [ga + 0.01 * (a - 1), gb + 0.01 * b]
        step = np.clip(np.linalg.solve([[haa + 0.01, hab], [hab, hbb + 0.01]], gradient), -1, 1)
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    # Sums of doubles differ in their last places from run to run.
    after.slope, after.offset = round(max(a, 0.05), 6), round(b, 6)
    points = []
    for made in (True, False):
        found = held.where((F.col("label") == 1) & (F.col("made") == made))
        points.append(kth_smallest(found, "logit", int(np.floor(found.count() * (1 - recall)))))
    points = [point for point in points if point is not None]
    if not points:
        after.threshold = 1.1
        return after
    below = held.where((F.col("label") == 0) & (logit < min(points))).agg(F.max("logit")).first()[0]
    chance = lambda x: 0.0 if x is None else float(1 / (1 + np.exp(-(after.slope * x + after.offset))))
    after.threshold = max(0.5, (chance(min(points)) + chance(below)) / 2)
    return after


def trained_on_all(distinct: DataFrame, made: tuple[list[str], list[str]], network: Network) -> Network:
    """A network trained on over all of ``distinct(window, label, h)`` and made keys and runs; its threshold comes from all held-out rows.

    As in ``fitted``, a first network names the unlabelled rows that look like findings, and the second learns without them.
    """
    rows = [(w, label, k % 5 == 0) for label, windows in ((1, made[0]), (0, made[1])) for k, w in enumerate(windows)]
    added = distinct.sparkSession.createDataFrame(rows, "window string, label int, held boolean").withColumn("made", F.lit(True))
    table = distinct.select("window", F.col("label").cast("int").alias("label"), (F.pmod("h", F.lit(5)) == 0).alias("held"), F.lit(False).alias("made"))
    every = table.unionByName(added)
    blocks = max(1, min(MOST_BLOCKS, every.count() // ROWS_PER_BLOCK))
    every = every.withColumn("block", F.pmod(F.xxhash64("window", F.lit(1)), F.lit(blocks)).cast("int"))

    def trained(on: DataFrame) -> Network:
        learning, model = stored(weighted(on.where(~F.col("held"))), "training"), network
        for rate in RATES:
            model = trained_in_blocks(learning, model, rate)
        return calibrated_on_all(scored(on.where("held"), model), model)

    first = trained(every)
    doubt = (F.col("label") == 0) & ~F.col("made") & (1 / (1 + F.exp(-(F.col("logit") * first.slope + first.offset))) >= first.threshold)
    judged = scored(every, first).withColumn("doubt", doubt)
    if judged.where("doubt").isEmpty():
        return first
    return trained(judged.where("NOT doubt").select(*every.columns))


def learn(scans: DataFrame, rows: int = TRAINING_ROWS) -> Network:
    """Train on all found and all other candidates, and on made ones; any table has a network.

    One window of each candidate takes part, and equal windows count once, a fifth of them held out. At most ``rows`` of each
    kind, those with the lowest hashes, start the network; where there are more, all rows train it on and set its
    threshold. A table without findings leaves the made keys to learn from.
    """

    @F.pandas_udf("string")
    def drawn(arounds: pd.Series) -> pd.Series:
        return arounds.map(drawn_window)

    windows = scans.select(F.explode("found").alias("c")).select(drawn("c.around").alias("window"), "c.label")
    distinct = stored(
        windows.groupBy("window").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("window")), "windows"
    )
    taken = []
    for label in (1, 0):
        lowest = distinct.where(F.col("label") == label).orderBy("h", "window").limit(rows).collect()
        taken.append([(r["window"], r["h"] % 5 == 0) for r in lowest])
    network = fitted(*taken)
    if distinct.groupBy("label").count().where(F.col("count") > rows).isEmpty():
        return network
    return trained_on_all(distinct, made_windows([w for w, _ in taken[1] or taken[0]]), network)


def merged(base: list, found: list, picked: list[bool]) -> list[tuple[int, str, int]]:
    """All findings as ``(start, kind, end)``, by start and then by kind in the order of ``KINDS``."""
    spans = [(int(b["start"]), KINDS.index(b["kind"]), int(b["end"])) for b in base]
    spans += [(int(c["start"]), 3, int(c["end"])) for c, yes in zip(found, picked, strict=True) if yes]
    return [(start, KINDS[kind], end) for start, kind, end in sorted(spans)]


def findings(scans: DataFrame, network: Network) -> DataFrame:
    """``(id, spans)``: all findings of every row, ``array<struct<start, kind, end>>``.

    The patterns' findings all stay; the network adds what they leave of candidates, each part as a whole.
    """
    sent = scans.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("array<struct<start: int, kind: string, end: int>>")
    def spans(bases: pd.Series, founds: pd.Series) -> pd.Series:
        model, out = sent.value, []
        others = [[c for c in found if c["label"] == 0] for found in founds]
        flat = [c["around"] for found in others for c in found]
        picked = iter(model.picks(flat))
        for base, found in zip(bases, others, strict=True):
            out.append(merged(base, found, [next(picked) for _ in found]))
        return pd.Series(out, dtype="object")

    return scans.select("id", "base", spans("base", "found").alias("spans"))


def redacted(
    docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with every finding replaced by ``mark``; overlapping findings become one mark.

    Other columns stay; documents without a finding keep every character, null texts stay null.
    """
    network = learn(stored(scanned(docs, id_col, text_col), "scans"))
    sent = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("string")
    def cover(texts: pd.Series) -> pd.Series:
        model, out = sent.value, []
        for text in texts:
            base = base_findings(text or "")
            found = [c for c in candidates(text or "", base) if c[2] == 0]
            picked = model.picks([c[3] for c in found])
            spans = sorted([(a, b) for a, b, _ in base] + [c[:2] for c, yes in zip(found, picked, strict=True) if yes])
            if not spans:
                out.append(text)
                continue
            kept, at = [], 0
            for a, b in spans:
                if a >= at:
                    kept += [text[at:a], mark]
                at = max(at, b)
            out.append("".join([*kept, text[at:]]))
        return pd.Series(out, dtype="object")

    # Not deterministic for the optimizer: no later expression on the text runs it once more.
    return docs.withColumn(text_col, cover.asNondeterministic()(F.col(text_col))).select(*docs.columns)
