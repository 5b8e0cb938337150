"""Prefix trie of conversations: compacted nodes hashed at their handles, fat binary search, insertion in batches.

A string is a conversation's sequence of turns; a prefix of it is known by its length and 122 bits of hash. The trie is a
table of compacted nodes. A node stands for the edge from its parent's ``extent`` (length ``p``) to its own (length ``e``);
its *handle* is its prefix at the two-fattest length in ``(p, e]``, the one divisible by the highest power of two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.llm.shared import placed_in_order, stored, text_batches

#: Prefix hashes are sums of the turns' hashes modulo this prime, two of them.
PRIME = (1 << 61) - 1
#: Ids that are joined to one text before a digest takes them.
IDS_AT_ONCE = 16384
#: Each batch is this many times as large as the one before.
GROWTH = 8
EDGE = 4096

NODE = "e int, e1 long, e2 long, p int, p1 long, p2 long, f int, f1 long, f2 long, n1 long, n2 long, sid long, upto long"


def running(df: DataFrame, key: str, order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """Add ``at``, the rows of the same key before a row, and ``upto_<name>``, sums over the key's rows up to it.

    Rows are range-partitioned by key and order, so a key of any size is spread over parts. Only the first key of a
    part can go on from an earlier one: what is carried is at most one short row per part.
    """
    placed = placed_in_order(df, [key, *order], name)
    added = {"rows": F.lit(1), **sums}
    lasts = placed.groupBy("_part").agg(F.max(key).alias("_last"))
    of_last = placed.join(F.broadcast(lasts), "_part").where(F.col(key) == F.col("_last")).groupBy("_part", "_last").agg(
        *[F.sum(amount.cast("decimal(20,0)")).alias(f"_in_{n}") for n, amount in added.items()]
    )
    so_far = Window.partitionBy("_last").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = of_last.select("_part", F.col("_last").alias(key), *[F.sum(f"_in_{n}").over(so_far).alias(f"_carry_{n}") for n in added])
    carry = carry.withColumn("_part", F.lead("_part").over(Window.orderBy("_part"))).where(F.col("_part").isNotNull())
    inside = Window.partitionBy("_part", key).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select("*", *[F.sum(amount.cast("decimal(20,0)")).over(inside).alias(f"_sum_{n}") for n, amount in added.items()])
    joined = local.join(F.broadcast(carry), [key, "_part"], "left")
    total = {n: F.col(f"_sum_{n}") + F.coalesce(f"_carry_{n}", F.lit(0)) for n in added}
    return joined.select(
        *df.columns, (total["rows"] - 1).cast("long").alias("at"), *[total[n].alias(f"upto_{n}") for n in sums]
    )


def previous(df: DataFrame, key: str, order: str, columns: list[str], name: str) -> DataFrame:
    """Add ``before``, the struct of ``columns`` of the row before, by order, of the same key; null at its first row."""
    placed = placed_in_order(df, [key, order], name)
    row = F.struct(*columns)
    inside = Window.partitionBy("_part", key).orderBy(order, "_tie")
    lasts = placed.groupBy("_part").agg(F.max(F.struct(key, order, *[c for c in columns if c != order])).alias("_last"))
    # One row per part.
    lasts = lasts.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_last"))
    carried = F.when(F.col(f"_last.{key}") == F.col(key), F.struct(*[F.col(f"_last.{c}").alias(c) for c in columns]))
    local = placed.withColumn("_before", F.lag(row).over(inside))
    return local.join(F.broadcast(lasts), "_part", "left").select(*df.columns, F.coalesce("_before", carried).alias("before"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv, at, t1, t2, chars)``: each turn's place in its conversation, its two hashes and its code points.

    Turns go by ``turn``, nulls first; equal turns by role and text. A null role or text is empty.
    """
    empty = F.lit("")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
    )
    placed = running(rows, "conv", ["turn", "role", "text"], {}, "turns")
    return placed.select(
        "conv", "at", F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"),
        F.length("text").cast("long").alias("chars"),
    )


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another: ``(conv, at, t1, t2, chars)``, and all ``conv``.

    The first h turns of conversation c come from conversation c - c % ``every`` (all, if it has fewer; none, if there is no
    such conversation), then c's own turns after its first h follow; h is the checksum of c modulo ``most``.
    """
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    base = F.col("conv") - F.col("conv") % every
    convs = stored(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "conversations")
    given = turns.where((F.col("conv") % every == 0) & (F.col("at") < most)).withColumnRenamed("conv", "base")
    taken = convs.select("conv", head.alias("h"), base.alias("base")).join(given, "base").where(F.col("at") < F.col("h"))
    held = convs.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.col("n").alias("held"))
    own = turns.select("*", head.alias("h"), base.alias("base")).where(F.col("at") >= F.col("h")).join(held, "base", "left")
    moved = F.col("at") - F.col("h") + F.least(F.col("h"), F.coalesce("held", F.lit(0)))
    columns = ["conv", "at", "t1", "t2", "chars"]
    return taken.select(*columns).unionByName(own.withColumn("at", moved).select(*columns)), convs.select("conv")


def _term(number: int) -> Column:
    """A turn's share in the hash of every prefix that it is part of."""
    return F.xxhash64(F.lit(number), "at", "t1", "t2").bitwiseAND(F.lit(PRIME))


def _reduced(total: Column) -> Column:
    return (total % F.lit(PRIME).cast("decimal(20,0)")).cast("long")


def strings_of(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal conversations are one string, named by its smallest member: ``(sid, len, n, chars)``, and members ``(sid, conv)``."""
    sums = [F.sum(_term(k).cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)]
    each = turns.groupBy("conv").agg(F.count(F.lit(1)).cast("int").alias("len"), F.sum("chars").alias("chars"), *sums)
    key = ["len", "h1", "h2"]
    summed = convs.join(each, "conv", "left").select(
        "conv", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("chars", F.lit(0)).alias("chars"),
        *[_reduced(F.coalesce(f"s{k}", F.lit(0).cast("decimal(30,0)"))).alias(f"h{k}") for k in (1, 2)],
    )
    summed = stored(summed, "sums")
    strings = summed.groupBy(*key).agg(F.min("conv").alias("sid"), F.count(F.lit(1)).alias("n"), F.first("chars").alias("chars"))
    strings = stored(strings, "strings")
    members = summed.select("conv", *key).join(strings.select("sid", *key), key).select("sid", "conv")
    return strings, members


def prefixes_of(turns: DataFrame, strings: DataFrame) -> DataFrame:
    """``(sid, depth, h1, h2, g1, g2, before, upto)``: hash of each string's prefixes, hash of the prefix one shorter, and code
    points before its last turn and with it."""
    own = turns.withColumnRenamed("conv", "sid").join(strings.where("len > 0").select("sid"), "sid", "left_semi")
    terms = own.select("sid", "at", "chars", _term(1).alias("x1"), _term(2).alias("x2")).withColumnRenamed("at", "place")
    summed = running(terms, "sid", ["place"], {"x1": F.col("x1"), "x2": F.col("x2"), "chars": F.col("chars")}, "prefixes")
    upto = F.col("upto_chars").cast("long")
    return stored(
        summed.select(
            "sid", (F.col("place") + 1).cast("int").alias("depth"),
            *[_reduced(F.col(f"upto_x{k}")).alias(f"h{k}") for k in (1, 2)],
            *[_reduced(F.col(f"upto_x{k}") - F.col(f"x{k}")).alias(f"g{k}") for k in (1, 2)],
            (upto - F.col("chars")).alias("before"), upto.alias("upto"),
        ),
        "prefixes",
    )


def two_fattest(low: Column, high: Column) -> Column:
    """The number in ``(low, high]`` that the highest power of two divides."""
    differing = F.length(F.bin(low.bitwiseXOR(high).cast("long"))) - 1
    return high - high % F.pow(F.lit(2.0), differing).cast("int")


def _at(prefixes: DataFrame, **names: str) -> DataFrame:
    """Prefix rows as a lookup: ``sid`` and ``depth`` stay, other columns take the given names."""
    return prefixes.select("sid", "depth", *[F.col(c).alias(n) for c, n in names.items()])


def locate(batch: DataFrame, nodes: DataFrame, prefixes: DataFrame, rounds: int) -> DataFrame:
    """Where each string ``(sid, len)`` leaves the trie: ``(sid, len, l, l1, l2, t, t1, t2)``.

    ``l`` with its hash is the extent of the deepest node whose extent is a prefix of the string; ``t`` with its hash is that of
    the exit node below, whose edge the string follows for a part; null where there is none.

    Fat binary search: each round looks up the prefix of two-fattest length in what is left of the interval. It is the
    handle of a node, whose extent then starts the interval, or the interval ends before it. A
    prefix that matches no handle of its path by accident of length cannot hide a node that the string passes as a whole.
    """
    here = ["e", "e1", "e2", "p", "p1", "p2"]
    state = batch.select("sid", "len", F.lit(0).alias("l"), F.col("len").alias("r"), *[F.lit(0).cast("long" if c[1:] else "int").alias(c) for c in here])
    handles = nodes.select("f", "f1", "f2", *[F.col(c).alias(f"_{c}") for c in here])
    for _ in range(rounds):
        # Strings that are done ask for a depth that no prefix has, each for its own.
        open_ = F.col("l") < F.col("r")
        asked = state.withColumn("depth", F.when(open_, two_fattest(F.col("l"), F.col("r"))).otherwise(F.lit(-1)))
        hashed = asked.join(_at(prefixes, h1="f1", h2="f2"), ["sid", "depth"], "left").select(
            "*", F.col("depth").alias("f")
        ).withColumn("f1", F.coalesce("f1", "sid"))
        found = hashed.join(handles, ["f", "f1", "f2"], "left")
        hit = F.col("_e").isNotNull()
        state = stored(
            found.select(
                "sid", "len", F.when(hit, F.col("_e")).otherwise(F.col("l")).alias("l"),
                F.when(open_ & ~hit, F.col("f") - 1).otherwise(F.col("r")).alias("r"),
                *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in here],
            ),
            "search",
        )
    extents = prefixes.select("sid", F.col("depth").alias("l"), F.col("h1").alias("x1"), F.col("h2").alias("x2"))
    checked = state.join(extents, ["sid", "l"], "left")
    passed = (F.col("l") == 0) | F.coalesce((F.col("x1") == F.col("e1")) & (F.col("x2") == F.col("e2")), F.lit(False))
    placed = checked.withColumn("passed", passed).select(
        "sid", "len", "passed",
        *[F.when(F.col("passed"), F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("e", "p", "l"), ("e1", "p1", "l1"), ("e2", "p2", "l2"))],
        *[F.when(~F.col("passed"), F.col(c)).alias(n) for c, n in (("e", "t"), ("e1", "t1"), ("e2", "t2"))],
    )
    below = placed.withColumn("depth", F.when(F.col("passed"), F.col("l") + 1).otherwise(F.lit(-1)))
    named = below.join(_at(prefixes, h1="n1", h2="n2"), ["sid", "depth"], "left").withColumn("n1", F.coalesce("n1", "sid"))
    children = nodes.select((F.col("p") + 1).alias("depth"), "n1", "n2", *[F.col(c).alias(f"_{c}") for c in ("e", "e1", "e2")])
    exits = named.join(children, ["depth", "n1", "n2"], "left")
    return exits.select(
        "sid", "len", "l", "l1", "l2", *[F.coalesce(n, f"_{c}").alias(n) for c, n in (("e", "t"), ("e1", "t1"), ("e2", "t2"))]
    )


def edge_depths(nodes: DataFrame) -> DataFrame:
    """A row for each depth of each node's edge; long edges are cut first, so no row holds them as a list."""
    parts = nodes.withColumn("_from", F.explode(F.sequence(F.col("p") + 1, F.col("e"), F.lit(EDGE))))
    return parts.withColumn("depth", F.explode(F.sequence("_from", F.least(F.col("_from") + EDGE - 1, F.col("e"))))).drop("_from")


def insert(batch: DataFrame, nodes: DataFrame, prefixes: DataFrame, rounds: int, first: bool) -> DataFrame:
    """The trie with the strings ``(sid, len)`` of a batch: exit nodes are split, new branches and ends become nodes.

    The prefixes of the strings below the extents that they pass, and those along the edges of their exit nodes, are brought
    together by hash. Of these, ends of strings, old extents and prefixes with two or more continuations become nodes.
    """
    if first:
        where = batch.select("sid", "len", F.lit(0).alias("l"), *[F.lit(0).cast("long").alias(c) for c in ("l1", "l2")])
        left = nodes
    else:
        where = stored(locate(batch, nodes, prefixes, rounds), "exits")
        touched = where.where("t is not null").select(F.col("t").alias("e"), F.col("t1").alias("e1"), F.col("t2").alias("e2")).distinct()
        split = stored(nodes.join(touched, ["e", "e1", "e2"], "left_semi"), "split")
        left = nodes.join(split.select("e", "e1", "e2"), ["e", "e1", "e2"], "left_anti")
    columns = ["sid", "depth", "h1", "h2", "g1", "g2", "upto", "l", "l1", "l2"]
    rows = prefixes.join(where.select("sid", "len", "l", "l1", "l2"), "sid").where(F.col("depth") > F.col("l"))
    rows = rows.select(*columns, (F.col("depth") == F.col("len")).alias("end"))
    if not first:
        edges = edge_depths(split.select("sid", "e", "p", F.col("p").alias("l"), F.col("p1").alias("l1"), F.col("p2").alias("l2")))
        old = edges.join(prefixes, ["sid", "depth"]).select(*columns, (F.col("depth") == F.col("e")).alias("end"))
        rows = rows.unionByName(old)
    rows = stored(rows, "region")
    grouped = rows.groupBy("depth", "h1", "h2").agg(
        F.min("sid").alias("sid"), F.max("end").alias("end"), *[F.first(c).alias(c) for c in ("g1", "g2", "upto")]
    )
    grouped = stored(grouped, "prefix-nodes")
    branching = grouped.groupBy((F.col("depth") - 1).alias("depth"), F.col("g1").alias("h1"), F.col("g2").alias("h2")).agg(
        F.count(F.lit(1)).alias("children")
    ).where("children > 1")
    kept = grouped.join(branching, ["depth", "h1", "h2"], "left").where(F.col("end") | F.col("children").isNotNull())
    kept = stored(kept.select("depth", "h1", "h2", F.col("sid").alias("named_by"), "upto"), "kept")
    paths = rows.select("sid", "depth", "h1", "h2", "l", "l1", "l2").join(kept, ["depth", "h1", "h2"])
    above = previous(paths, "sid", "depth", ["depth", "h1", "h2"], "paths").where("sid = named_by")
    inside = F.coalesce(F.col("before.depth") > F.col("l"), F.lit(False))
    new = above.select(
        "sid", "upto", F.col("depth").alias("e"), F.col("h1").alias("e1"), F.col("h2").alias("e2"),
        *[F.when(inside, F.col(f"before.{a}")).otherwise(F.col(b)).alias(n) for a, b, n in (("depth", "l", "p"), ("h1", "l1", "p1"), ("h2", "l2", "p2"))],
    ).withColumn("f", two_fattest(F.col("p"), F.col("e")))
    by_handle = prefixes.select("sid", F.col("depth").alias("f"), F.col("h1").alias("f1"), F.col("h2").alias("f2"))
    by_name = prefixes.select("sid", (F.col("depth") - 1).alias("p"), F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    new = new.join(by_handle, ["sid", "f"]).join(by_name, ["sid", "p"])
    return stored(left.unionByName(new.select(*left.columns)), "trie")


def compacted(strings: DataFrame, prefixes: DataFrame, batches: int = 2) -> DataFrame:
    """The table of compacted nodes below the root (schema ``NODE``), from strings inserted in growing batches."""
    spark = strings.sparkSession
    nodes = spark.createDataFrame([], NODE)
    longest = strings.agg(F.max("len")).first()[0] or 0
    shares = [GROWTH**k for k in range(batches)]
    draw = F.pmod(F.xxhash64("sid"), F.lit(sum(shares)))
    for k in range(batches):
        mine = strings.where("len > 0").where((draw >= sum(shares[:k])) & (draw < sum(shares[: k + 1]))).select("sid", "len")
        nodes = insert(mine, nodes, prefixes, longest.bit_length() + 1, first=k == 0)
    return nodes


def subtree_totals(nodes: DataFrame, sums: list[str], least: str) -> DataFrame:
    """Sum columns and take the minimum of ``least`` over each node's subtree; ``nodes`` have ``nid`` and ``parent``.

    By doubling: after k rounds a node holds its descendants nearer than 2^k, and knows its ancestor at that distance.
    """
    state = stored(nodes.withColumn("above", F.col("parent")), "subtrees")
    while not state.where("above is not null").isEmpty():
        given = state.where("above is not null").groupBy(F.col("above").alias("nid")).agg(
            *[F.sum(c).alias(f"_{c}") for c in sums], F.min(least).alias(f"_{least}")
        )
        ups = state.select(F.col("nid").alias("key"), F.col("above").alias("_up"))
        # Nodes below the root ask for a key that no node has, each for its own.
        keyed = state.withColumn("key", F.coalesce("above", -F.col("nid") - 1))
        joined = keyed.join(given, "nid", "left").join(ups, "key", "left")
        others = [c for c in state.columns if c not in (*sums, least, "above")]
        state = stored(
            joined.select(
                *others, *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums],
                F.least(least, f"_{least}").alias(least), F.col("_up").alias("above"),
            ),
            "subtrees",
        )
    return state.drop("above")


def id_digests(members: DataFrame) -> DataFrame:
    """``(sid, digest)``: SHA-256 of each string's member ids, ascending and comma-joined.

    Ids are ranked over a range partitioning and joined to texts of ``IDS_AT_ONCE`` by many tasks; one task
    then takes the texts of a string in turn and holds the state of the digest only.
    """
    ranked = running(members, "sid", ["conv"], {}, "members")
    texts = ranked.groupBy("sid", F.floor(F.col("at") / IDS_AT_ONCE).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda i: i.cast("string")), ",").alias("ids")
    )
    in_turn = texts.repartition("sid").sortWithinPartitions("sid", "block")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sid, state = None, None
        for batch in batches:
            done = []
            for name, block, ids in zip(batch["sid"].tolist(), batch["block"].tolist(), batch["ids"].tolist(), strict=True):
                if block == 0:
                    if state is not None:
                        done.append((sid, state.hexdigest()))
                    sid, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["sid", "digest"]).astype({"sid": "int64"})
        if state is not None:
            yield pd.DataFrame({"sid": [sid], "digest": [state.hexdigest()]})

    return text_batches(in_turn).mapInPandas(digest, "sid long, digest string")


def prefix_trie(turns: DataFrame, convs: DataFrame, batches: int = 2) -> DataFrame:
    """The trie of conversations ``(conv, at, t1, t2, chars)``, expanded to one row per distinct prefix, the root included.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: the smallest
    member, the prefix's length, the smallest member of the prefix one shorter, members, continuations, childless
    nodes in the subtree, code points of last turns that all but one member repeat, summed over the subtree, and a digest
    of the members that end here. ``convs(conv)`` are all members, those without turns as well; equal conversations are
    members of one string. No conversations give no rows. Turns whose two 64-bit hashes agree are equal.
    """
    strings, members = strings_of(turns, convs)
    prefixes = prefixes_of(turns, strings)
    nodes = compacted(strings, prefixes, batches)
    numbered = stored(nodes.withColumn("nid", F.monotonically_increasing_id()), "numbered")
    up = numbered.select(F.col("nid").alias("parent"), F.col("upto").alias("start"), *[F.col(f"e{k}").alias(f"p{k}") for k in ("", "1", "2")])
    up = up.select("parent", "start", F.col("p"), "p1", "p2")
    fan = numbered.where("p > 0").groupBy(F.col("p").alias("e"), F.col("p1").alias("e1"), F.col("p2").alias("e2")).agg(F.count(F.lit(1)).alias("fan"))
    held = strings.where("len > 0").select(
        F.col("len").alias("e"), F.col("h1").alias("e1"), F.col("h2").alias("e2"), "n", "chars", F.col("sid").alias("ends")
    )
    key = ["e", "e1", "e2"]
    tree = numbered.join(up, ["p", "p1", "p2"], "left").join(fan, key, "left").join(held, key, "left")
    n = F.coalesce("n", F.lit(0))
    tree = tree.select(
        "nid", "parent", "sid", "p", "e", "ends", F.coalesce("fan", F.lit(0)).alias("fan"), F.coalesce("start", F.lit(0)).alias("start"),
        n.alias("n_convs"), (n * F.coalesce("chars", F.lit(0))).alias("chars"),
        (F.col("upto") - F.coalesce("start", F.lit(0))).alias("edges"), F.when(F.col("fan").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        F.col("ends").alias("conv_id"),
    )
    total = subtree_totals(tree, ["n_convs", "chars", "edges", "n_leaves"], "conv_id")
    # Members' code points below the parent, less one copy of each edge.
    total = total.withColumn("saved", F.col("chars") - F.col("n_convs") * F.col("start") - F.col("edges"))
    total = stored(total, "totals")
    digests = stored(id_digests(members), "digests")
    nothing = hashlib.sha256(b"").hexdigest()

    parents = total.select(F.col("nid").alias("parent"), F.col("conv_id").alias("parent_conv"))
    ended = digests.select(F.col("sid").alias("ends"), "digest")
    edges = total.join(parents, "parent", "left").join(ended, "ends", "left")
    least, every = strings.agg(F.min("sid"), F.sum("n")).first()
    last, first_ = F.col("depth") == F.col("e"), F.col("depth") == F.col("p") + 1
    spread = edge_depths(edges).join(prefixes.select("sid", "depth", "before"), ["sid", "depth"])
    below = spread.select(
        "conv_id", F.col("depth").cast("long").alias("depth"),
        F.when(~first_, F.col("conv_id")).when(F.col("p") == 0, F.lit(least).cast("long")).otherwise(F.col("parent_conv")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("fan")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("before") - F.col("start"))).alias("saved_tokens"),
        F.when(last, F.coalesce("digest", F.lit(nothing))).otherwise(F.lit(nothing)).alias("ends_sha256"),
    )
    if least is None:
        return below
    fan, leaves, saved = total.where("p = 0").agg(F.count(F.lit(1)), F.sum("n_leaves"), F.sum("saved")).first()
    turnless = strings.where("len = 0").select("sid").join(digests, "sid").first()
    root = (least, 0, None, every, fan, max(1, leaves or 0), saved or 0, nothing if turnless is None else turnless["digest"])
    return below.unionByName(turns.sparkSession.createDataFrame([root], below.schema))
