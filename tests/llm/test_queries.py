"""The registered queries against brute force on small tables, and on empty ones."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from compare import connect, difference

from symloom.llm import langid, secrets
from symloom.llm.licenses import NOTICES, PHRASES, block_step, template_words
from symloom.llm.queries import CAPACITY, URL_RULES, registered
from symloom.llm.sql import ORACLES

QUERIES = registered()
GIVEN = "/root/testdata/sf0.001"


def rows_of(spark, name, folder):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables_give_no_rows(spark, nothing, name):
    assert rows_of(spark, name, nothing) == []


@pytest.mark.parametrize("name", ORACLES)
def test_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, GIVEN), connect(GIVEN).sql(ORACLES[name])) is None


@pytest.fixture(scope="module")
def token_ids(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, _ in documents]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_holds_every_token_once(spark, small, token_ids):
    rows = rows_of(spark, "op1_packing", small)
    whole = Counter((i, len(ids) + 1) for i, ids in token_ids)
    starts = Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert starts == whole
    wanted = Counter()
    for i, ids in token_ids:
        ids = [*ids, 1]
        for a in range(0, len(ids), CAPACITY):
            part = ids[a : a + CAPACITY]
            wanted[(i, a, len(part), crc(part))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    sequences = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= CAPACITY
    least = -(-sum(sequences.values()) // CAPACITY)
    assert len(sequences) <= 1.05 * least + 1


def test_wavelet_files_give_the_ids_back(spark, small, token_ids):
    rows = rows_of(spark, "op2_wavelet_files", small)
    wanted = Counter((i, len(ids) + 1, crc([*ids, 2])) for i, ids in token_ids)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == wanted
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert known == sorted(known)


def test_language_of_every_text(spark, small, documents):
    rows = rows_of(spark, "op3_rank_order_profiles", small)
    assert len(rows) == len(documents)
    texts = {}
    for i, t, _ in documents:
        texts.setdefault(i, []).append(t)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        letters = [t is not None and any(c.isalpha() for c in t) for t in texts[r["doc_id"]]]
        assert (r["lang_pred"] == "und") in {not x for x in letters}
        assert 0 <= r["score"] <= 1


def plain_grams(text):
    """The counts of the 1- to 3-grams of a text's words, the most frequent first, shorter ones and lower characters before others."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    line = f" {' '.join(words)} " if words else ""
    counts = Counter(c for c in line if c != " ")
    counts.update(line[k : k + 2] for k in range(len(line) - 1))
    counts.update(line[k : k + 3] for k in range(len(line) - 2) if line[k + 1] != " ")
    return counts


def in_order(counts):
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:400]


def test_languages_equal_brute_force(spark, small, documents):
    totals = {}
    for i, text, lang in documents:
        if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            totals.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {lang: {g: rank for rank, g in enumerate(in_order(c))} for lang, c in sorted(totals.items()) if c}
    assert len(profiles) > 2
    wanted = Counter()
    for i, text, _ in documents:
        own = in_order(plain_grams(text))
        apart = {
            lang: sum(abs(ranks[g] - k) if g in ranks else 400 for k, g in enumerate(own)) for lang, ranks in profiles.items()
        }
        lang = min(apart, key=apart.get) if own else "und"
        wanted[(i, lang, round(1 - apart[lang] / (400 * len(own)), 9) if own else 0.0)] += 1
    rows = rows_of(spark, "op3_rank_order_profiles", small)
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in rows) == wanted


@pytest.mark.parametrize("text, letters", [("½ ² Ⅷ ٣", ""), ("x² a½b", "xab"), ("é_日9", "é日")])
def test_only_letters_make_grams(text, letters):
    grams, counts = langid.grams_of(text)
    assert {chr(g) for g in grams if g < 1 << 21} == set(letters)
    assert sum(counts) == sum(plain_grams(text).values())


def test_held_out_languages_are_told(spark):
    rows = QUERIES["op3_rank_order_profiles"](spark, GIVEN).where("held_out").collect()
    languages = dict(connect(GIVEN).sql("SELECT doc_id, lang FROM documents").fetchall())
    right = sum(languages[r["doc_id"]] == r["lang_pred"] for r in rows)
    assert rows and right >= 0.97 * len(rows)


def test_shards_are_contiguous_and_balanced(spark, small, documents):
    rows = rows_of(spark, "op4_byte_shards", small)
    size = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in documents)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == size
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    ids = [r["doc_id"] for r in order if r["doc_id"] is not None]
    assert ids == sorted(ids)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    before = 0
    slots = Counter()
    for r in order:
        assert r["shard"] == min(23, (2 * before + r["size"]) * 24 // (2 * total))
        assert r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        before += r["size"]
    assert largest < total


def literal_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, small, documents):
    prints = [(i, literal_fingerprint(t)) for i, t, _ in documents]
    group = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= 3 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    first = {}
    for (i, _), g in zip(prints, group, strict=True):
        if i is not None:
            first[g] = min(first.get(g, i), i)
    wanted = Counter((i, f"{p:016x}", first.get(g)) for (i, p), g in zip(prints, group, strict=True))
    rows = rows_of(spark, "op5_simhash", small)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == wanted
    assert len(set(group)) < len({p for _, p in prints})


def literal_repeats(texts, span=200):
    starts = Counter(t[p : p + span] for t in texts for p in range(len(t) - span + 1))
    result = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - span + 1):
            if starts[t[p : p + span]] > 1:
                gone[p : p + span] = True
        runs = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        result.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return result


def test_repeated_bytes(spark, small, documents):
    rows = rows_of(spark, "op6_suffix_dedup", small)
    found = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
    literal = literal_repeats([(t or "").encode() for _, t, _ in documents])
    assert found == Counter((i, *x) for (i, _, _), x in zip(documents, literal, strict=True))


def test_contaminated_words(spark, small, documents):
    def words(text):
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    items = pq.read_table(f"{small}/benchmark.parquet").to_pylist()
    windows = {}
    for item in items:
        w = words(item["text"])
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else []:
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if item["item_id"] is None else str(item["item_id"]))
    wanted = Counter()
    for i, text, _ in documents:
        w, hit, found = words(text), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        wanted[(i, len(w), len(hit), len(found), digest, bool(hit))] += 1
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = rows_of(spark, "op7_decontamination", small)
    assert Counter(tuple(r[c] for c in names) for r in rows) == wanted
    assert sum(r["contaminated"] for r in rows) >= 5


def test_hosts_paths_and_rules(spark, small):
    rows = rows_of(spark, "op8_url_filter", small)
    pages = pq.read_table(f"{small}/pages.parquet").to_pylist()
    wanted = Counter()
    for page in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", page["url"] or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fitting = [
            rule for rule in URL_RULES
            if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])
        ]
        wanted[(page["page_id"], host, path, max(fitting, key=len, default=None))] += 1
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in rows) == wanted
    for r in rows:
        assert r["verdict"] == URL_RULES[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block")


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def literal_findings(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def plain_probability(network, window):
    """The network's answer for one window, place by place."""
    codes = [0 if c == "\0" else secrets.SYMBOLS.get(c, 1) for c in window]
    w, span = network.weights, network.span
    total, count = 0, 0
    best = {True: np.full(w["shift"].size, -1.0), False: np.full(w["shift"].size, -1.0)}
    for at in range(len(codes) - span + 1):
        response = np.maximum(np.concatenate([w["embed"][c] for c in codes[at : at + span]]) @ w["conv"] + w["shift"], 0)
        within = secrets.LEFT <= at and at + span <= secrets.LEFT + secrets.HEAD + secrets.TAIL
        best[within] = np.maximum(best[within], response)
        if within:
            total, count = total + response, count + 1
    logit = np.concatenate([best[True], best[False], total / count]) @ w["out"] + w["bias"][0]
    return 1 / (1 + np.exp(-(network.slope * logit + network.offset)))


def planted_documents():
    """Keys that no pattern matches, half of them after a name that is no key word, and as many ordinary runs."""
    rng = random.Random(3)
    alphabets = ["0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_letters + string.digits]
    rows = []
    for k in range(60):
        key = "".join(rng.choice(alphabets[k % 3]) for _ in range(32))
        word = "-".join(rng.choice(["river", "stone", "garden", "window", "morning"]) for _ in range(4))
        named = "credential = " if k % 2 else ""
        rows += [(k, f"the light of the {named}{key} house in winter"), (100 + k, f"the light of the {named}{word} house in winter")]
    return rows


@pytest.mark.parametrize("planted", [False, True])
def test_secrets_equal_brute_force(spark, small, documents, planted, tmp_path):
    rows = [(i, text or "") for i, text, _ in documents]
    folder = small
    if planted:
        rows += planted_documents()
        folder = str(tmp_path)
        pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), f"{folder}/documents.parquet")
    cands = {text: secrets.candidates(text, secrets.base_findings(text)) for _, text in rows}
    labels = {}
    for found in cands.values():
        for *_, label, around in found:
            window = secrets.drawn_window(around)
            labels[window] = max(label, labels.get(window, 0))
    hashes = {w: np.uint64(xxhash.xxh64(w.encode(), seed=42).intdigest()).astype(np.int64).item() for w in labels}
    taken = [[(w, hashes[w] % 5 == 0) for w in sorted(labels, key=lambda w: (hashes[w], w)) if labels[w] == n] for n in (1, 0)]
    network = secrets.fitted(*taken)
    wanted = Counter()
    learned = Counter()
    for i, text in rows:
        base = literal_findings(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        more = []
        for a, b, label, around in cands[text]:
            windows = [secrets.window_at(around, at) for at in secrets.window_starts(around)]
            if not label and max(plain_probability(network, w) for w in windows) >= network.threshold:
                more.append((a, 3, b, "learned"))
        learned[i] += len(more)
        spans = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(base + more))
        kinds = Counter(f[3] for f in base)
        digest = hashlib.sha256(joined.encode()).hexdigest()
        wanted[(i, kinds["assign"], kinds["access"], kinds["hex"], digest, spans)] += 1
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    answer = rows_of(spark, "op9_secret_scan", folder)
    assert Counter(tuple(r[c] for c in names) for r in answer) == wanted
    assert sum(r["n_assign"] for r in answer) >= 3 and sum(r["n_hex"] for r in answer) >= 1
    if planted:
        shared = {i for i, _, _ in documents}
        assert sum(learned[k] for k in range(60) if k not in shared) >= 0.9 * len([k for k in range(60) if k not in shared])
        assert sum(learned[100 + k] for k in range(60)) <= 1


def test_exact_top_k(spark, small):
    table = pq.read_table(f"{small}/embeddings.parquet").to_pylist()
    sound = [
        (k, r["vec_id"], [int(np.floor(256 * float(x))) for x in r["embedding"]])
        for k, r in enumerate(table)
        if r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"])
    ]
    wanted = Counter()
    for k, i, q in sound:
        if i is None or i % 50:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(q, v, strict=False)), float("inf") if j is None else j, j) for n, j, v in sound if n != k
        )
        for rank, (score, _, j) in enumerate(scored[:5], 1):
            wanted[(i, rank, j, -score)] += 1
    rows = rows_of(spark, "op10_norm_bucketed_search", small)
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows) == wanted


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def literal_licenses(text):
    """Every phrase at every place, every notice against every block."""
    w, places, labels, score = license_words(text), [], set(), 0.0
    for t in PHRASES:
        p = template_words(t.text)
        places += [(k, t.label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    if places:
        score = 1.0
    for t in NOTICES:
        own, step = set(template_words(t.text)), block_step(t)
        for k in range(0, len(w), step):
            part = len(own & set(w[k : k + 2 * step])) / len(own)
            if part >= t.least:
                labels.add(t.label)
                score = max(score, part)
    base = {label for _, label in places}
    starts = [k for k, _ in places]
    joined = [",".join(sorted(x)) for x in (base, base | labels)]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), *joined, score


def test_licenses(spark, small, documents):
    rows = rows_of(spark, "op11_license_scan", small)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    wanted = Counter((i, *literal_licenses(t)) for i, t, _ in documents)
    assert Counter(tuple(r[c] for c in names) for r in rows) == wanted
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert (labels[17], labels[18], labels[19]) == ("apache,gpl,mit", "all-rights-reserved,mit", "all-rights-reserved,cc-by-nc,gpl")
    assert [r["n_base"] for r in rows if r["doc_id"] == 17] == [4]


def literal_clusters(table, count=16, rounds=3):
    sound = [
        (r["vec_id"], [int(np.floor(64 * float(x))) for x in r["embedding"]])
        for r in table
        if r["embedding"] is not None and len(r["embedding"]) == 64 and all(x is not None and np.isfinite(x) for x in r["embedding"])
    ]
    hashed = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in sound)
    centroids = [v for _, v in hashed[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        mine = {}
        for _, v in sound:
            mine.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(mine[k]) for x in zip(*mine[k], strict=True)] if k in mine else c for k, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in sound]
    inertia = Counter()
    for _, distance, k in found:
        inertia[k] += distance
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, k, distance, inertia[k], sum(inertia.values()), digest[k]) for i, distance, k in found)


def test_clusters(spark, small):
    rows = rows_of(spark, "op12_simplex_clusters", small)
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    wanted = literal_clusters(pq.read_table(f"{small}/embeddings.parquet").to_pylist())
    assert Counter(tuple(r[c] for c in names) for r in rows) == wanted
    assert len(rows) == 52


def literal_trie(rows):
    """One row per distinct prefix, from all prefixes of all rebuilt conversations."""
    own = {}
    for r in rows:
        if r["conv_id"] is not None:
            key = (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")
            own.setdefault(r["conv_id"], []).append(key)
    own = {c: [k[2:] for k in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, convs in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(convs) - 1) * len(n[-1][1]) if n else 0
    digest = {n: hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest() for n in members}
    return Counter(
        (min(c), len(n), min(members[n[:-1]]) if n else None, len(c), children[n], leaves[n], saved[n], digest[n])
        for n, c in members.items()
    )


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_of_conversations(spark, small):
    rows = rows_of(spark, "op13_prefix_trie", small)
    wanted = literal_trie(pq.read_table(f"{small}/conversations.parquet").to_pylist())
    assert Counter(tuple(r[c] for c in TRIE) for r in rows) == wanted
    assert max(r["depth"] for r in rows) >= 130
