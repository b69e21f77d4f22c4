"""Prefix tries of conversations, with what a cache of shared openings would save.

A turn id is two 64-bit hashes of role and text; a path key is the running xor of a conversation's turn
ids mixed with their depths, so equal keys are equal openings and a key's parent is one xor away.
Conversations with equal paths are one *sequence* with a weight. Sequences hang in containers under
trie heads; all start in one container under the root:

* A container of more than ``CONTAINER_TURNS`` turns is burst: its sequences move under longer heads by
  their next turn ids, first one, then two, four and so on at a time. Containers only shrink on the
  way down, so one count of all of them at the depths 0, 1, 3, 7, ... tells where each sequence stays.
* The rest, each bounded, are dealt to shards of about ``SHARD_TURNS`` turns, which sort their
  sequences by turn ids and sweep them once into nodes.
* Heads are nodes too. Spark aggregates them by key, however many conversations share one, and sums of
  subtrees climb along the path of each head's smallest member: a sum along each sequence, then one by key.

No conversation, opening or group of copies is gathered in one place: positions come from a range
partitioned sort, running values from chunks of ``CHUNK`` turns, and lists of ids are digested in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoscope.llm import files

CONTAINER_TURNS, SHARD_TURNS = 4096, 1 << 14
#: Turns that one window holds, and ids in one piece of a digest.
CHUNK, PIECE_IDS = 1024, 4096
NO_IDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in order, and conversations. The first has ``conv_id, i`` (from 0), ``k1, k2`` (the turn id) and
    ``chars``; the second ``conv_id, total``. Null roles and texts are empty; null turn numbers come first;
    turns of one number are in the order of their ids, repeated rows one after the other; rows without
    ``conv_id`` belong to no conversation. Other columns are not read."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    hashed = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("k1"),
        F.xxhash64(F.lit(1), text, role).alias("k2"),
        F.length(text).cast("bigint").alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    by = ["conv_id", "turn", "k1", "k2", "row"]
    ordered = hashed.repartitionByRange(*by).sortWithinPartitions(*by)
    table, _ = files.written(ordered.select("conv_id", "k1", "k2", "chars", F.monotonically_increasing_id().alias("at")), "turns")
    part = F.shiftright("at", 33).alias("part")  # the range, as the ids count it
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans, _ = files.written(
        table.groupBy("conv_id", part)
        .agg(F.min("at").alias("first"), F.count("*").alias("n"))
        .withColumns({"before": F.coalesce(F.sum("n").over(ahead), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("conv_id"))}),
        "spans",
    )
    indexed = table.withColumn("part", part).join(spans, ["conv_id", "part"])
    return (
        indexed.select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("i"), "k1", "k2", "chars"),
        spans.filter("before = 0").select("conv_id", "total"),
    )


def opened_alike(ordered: DataFrame, convs: DataFrame, group: int, borrow: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with turns of the first one of their group, ``conv_id - conv_id % group``.

    ``borrow`` says how many turns (below ``most``) a conversation takes from there, instead of as many of its
    own; a first conversation that is shorter, or missing, gives what it has. Returns turns
    (``conv_id, depth`` from 1, ``k1, k2, chars, length``) and conversations (``conv_id, length``)."""
    openings = (
        ordered.filter((F.col("conv_id") % group == 0) & (F.col("i") < most - 1))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("i", "k1", "k2", "chars"))).alias("opening"))  # below ``most`` turns
    )
    taken, _ = files.written(
        convs.withColumns({"base": F.expr(f"conv_id - conv_id % {group}"), "h": borrow})
        .join(openings, "base", "left")
        .withColumn("opening", F.expr("slice(opening, 1, cast(h as int))"))
        .withColumn("m", F.coalesce(F.size("opening"), F.lit(0)))
        .select("conv_id", "h", "m", "opening", (F.col("m") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length")),
        "rebuilt",
    )
    own = (
        ordered.join(taken.select("conv_id", "h", "m", "length"), "conv_id")
        .filter("i >= h")
        .select("conv_id", F.expr("i - h + m + 1").alias("depth"), "k1", "k2", "chars", "length")
    )
    borrowed = taken.select("conv_id", "length", F.posexplode("opening").alias("at", "turn")).select(
        "conv_id", (F.col("at") + 1).cast("bigint").alias("depth"), "turn.k1", "turn.k2", "turn.chars", "length"
    )
    return own.unionByName(borrowed), taken.select("conv_id", "length")


def _running(rows: DataFrame, key: str, values: dict[str, Column], how, merge, down: bool = False) -> DataFrame:
    """Adds to rows (with ``depth`` and ``length``) running values along each key by depth, or from the deepest
    row backwards (``down``). Windows hold a chunk of depths; what lies before a chunk comes from sums of
    whole chunks, which only keys longer than one chunk have."""
    order = F.desc if down else F.asc
    rows = rows.withColumns(values | {"chunk": F.expr(f"depth div {CHUNK}")})
    within = Window.partitionBy(key, "chunk").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(order("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.filter(F.col("length") >= CHUNK).groupBy(key, "chunk").agg(*[how(name).alias(name) for name in values])
    carried = whole.select(key, "chunk", *[F.coalesce(how(name).over(before), F.lit(0)).alias(f"carried_{name}") for name in values])
    summed = rows.withColumns({name: how(name).over(within) for name in values}).join(carried, [key, "chunk"], "left")
    total = {name: merge(F.col(name), F.coalesce(F.col(f"carried_{name}"), F.lit(0))) for name in values}
    return summed.withColumns(total).drop("chunk", *[f"carried_{name}" for name in values])


def _mixed(first: str, second: str, salt: int) -> Column:
    return F.xxhash64(F.col(first), F.col("depth"), F.lit(salt), F.col(second))


def _digests(members: DataFrame, key: list[str]) -> DataFrame:
    """``key, ends``: the digest of each key's ids in pieces (``piece, ids``), in order. SHA-256 goes through a
    list from its start, so a list is one task's stream, of which it holds a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            found = []
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in [*key, "ids"])):
                if at != now:
                    if state:
                        found.append([*now, state.hexdigest()])
                    now, state = at, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip([*key, "ends"], row)) for row in found], schema)
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip([*key, "ends"], [*now, state.hexdigest()]))], schema)

    schema = pa.schema([*[(c, pa.int64()) for c in key], ("ends", pa.string())])
    ordered = members.repartition(*key).sortWithinPartitions(*key, "piece").select(*key, "ids")
    return ordered.mapInArrow(run, ", ".join([*[f"{c} bigint" for c in key], "ends string"]))


def sequences(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for all conversations with one whole path: ``seq`` (the smallest id), ``w`` (how many),
    ``length`` and ``ends`` (the digest of their ids)."""
    key = ["length", "p1", "p2"]
    last = paths.filter("depth = length").select("conv_id", "p1", "p2")
    finals = convs.join(last, "conv_id", "left").fillna(0, ["p1", "p2"])
    members, _ = files.written(
        finals.groupBy(*key, F.expr(f"conv_id div {PIECE_IDS}").alias("piece"))
        .agg(F.count("*").alias("n"), F.sort_array(F.collect_list("conv_id")).alias("ids"))  # ids of one piece differ
        .select(*key, "piece", "n", F.col("ids")[0].alias("least"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")),
        "members",
    )
    whole = members.groupBy(*key).agg(
        F.sum("n").alias("w"), F.min("least").alias("seq"), F.count("*").alias("pieces"), F.min("ids").alias("ids")
    )
    split = _digests(members.join(whole.filter("pieces > 1").select(*key), key, "left_semi"), key).withColumnRenamed("ends", "joined")
    ends = F.when(F.col("pieces") == 1, F.sha2("ids", 256)).otherwise(F.col("joined"))
    return whole.join(split, key, "left").select("seq", "w", "length", ends.alias("ends"))


def place(paths: DataFrame, seqs: DataFrame, container_turns: int) -> DataFrame:
    """Where each sequence's container hangs: ``seq, w, length, ends`` with ``hd, c1, c2``, depth and key of the
    head."""
    mine = paths.join(seqs.select(F.col("seq").alias("conv_id")), "conv_id").select(F.col("conv_id").alias("seq"), "depth", "p1", "p2", "length")
    root = seqs.select("seq", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("p1"), F.lit(0).cast("bigint").alias("p2"), "length")
    stops, _ = files.written(mine.filter("depth & (depth + 1) = 0").unionByName(root), "stops")
    key = ["depth", "p1", "p2"]
    burst = stops.groupBy(*key).agg(F.sum(F.col("length") - F.col("depth")).alias("below")).filter(F.col("below") > container_turns)
    deepest = stops.join(burst.select(*key), key, "left_semi").groupBy("seq").agg(F.max("depth").alias("burst"))
    hung = seqs.join(deepest, "seq", "left").withColumn("hd", F.coalesce(F.least(F.col("burst") * 2 + 1, "length"), F.lit(0).cast("bigint")))
    heads = mine.unionByName(root).select("seq", F.col("depth").alias("hd"), F.col("p1").alias("c1"), F.col("p2").alias("c2"))
    return hung.join(heads, ["seq", "hd"]).select("seq", "w", "length", "ends", "hd", "c1", "c2")


_NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_SWEPT = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, is_node boolean, hd bigint, c1 bigint, c2 bigint"


def sweep(table: pa.Table) -> pa.Table:
    """Nodes of all containers of a shard, and a row for each container (``is_node`` false: its smallest member,
    its children under the head, its leaves and savings)."""
    get = {c: table.column(c).to_numpy() for c in ("seq", "depth", "hd", "c1", "c2", "k1", "k2", "chars", "w")}
    order = np.lexsort((get["depth"], get["seq"]))
    get = {c: v[order] for c, v in get.items()}
    ends = table.column("ends").take(pa.array(order)).to_pylist()
    pairs = np.stack([get["k1"], get["k2"]], axis=1)
    ids = np.unique(pairs, axis=0, return_inverse=True)[1].reshape(-1).tolist()
    starts = np.flatnonzero(np.append(True, get["seq"][1:] != get["seq"][:-1])).tolist()
    stops = [*starts[1:], len(ids)]
    heads = list(zip(*(get[c][starts].tolist() for c in ("hd", "c1", "c2"))))
    seqs, weights, chars = get["seq"][starts].tolist(), get["w"][starts].tolist(), get["chars"].tolist()
    paths = [ids[a:b] for a, b in zip(starts, stops)]

    out: dict[str, list] = {c: [] for c in (*_NODES, "ends_sha256", "is_node", "hd", "c1", "c2")}
    above: list[int] = []  # of each node row: its parent's row, or -1 under the head

    def add(conv, depth, n, children, leaves, saved, digest, is_node, head, parent):
        for c, v in zip(out, (conv, depth, None, n, children, leaves, saved, digest, is_node, *head)):
            out[c].append(v)
        above.append(parent)

    stack: list[list] = []  # open nodes: row, smallest member, members, children, leaves, saved, characters

    def close(keep: int) -> None:
        while len(stack) > keep:
            row, conv, n, children, leaves, saved, size = stack.pop()
            if row >= 0:
                saved += (n - 1) * size
                leaves = leaves or 1
            for c, v in (("conv_id", conv), ("n_convs", n), ("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved)):
                out[c][row if row >= 0 else -row - 1] = v
            if stack:
                top = stack[-1]
                top[1], top[2], top[3] = min(top[1], conv), top[2] + n, top[3] + 1
                top[4], top[5] = top[4] + leaves, top[5] + saved

    before, head = [], None
    for s in sorted(range(len(paths)), key=lambda s: (heads[s], paths[s])):
        path, at, least = paths[s], starts[s], seqs[s]
        if heads[s] != head:
            close(0)
            head, shared = heads[s], 0
            add(None, head[0], None, None, None, None, None, False, head, -1)
            stack.append([-len(above), least, 0, 0, 0, 0, 0])
        else:
            shared = next((i for i, (a, b) in enumerate(zip(before, path)) if a != b), min(len(before), len(path)))
            close(shared + 1)
        for i in range(shared, len(path)):
            add(None, head[0] + i + 1, None, None, None, None, NO_IDS, True, head, stack[-1][0])
            stack.append([len(above) - 1, least, 0, 0, 0, 0, chars[at + i]])
        stack[-1][1], stack[-1][2] = min(stack[-1][1], least), stack[-1][2] + weights[s]
        out["ends_sha256"][stack[-1][0]] = ends[stops[s] - 1]
        before = path
    close(0)
    for row, parent in enumerate(above):
        if parent >= 0:
            out["parent_conv_id"][row] = out["conv_id"][parent]
    kinds = {"ends_sha256": pa.string(), "is_node": pa.bool_()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def build(ordered: DataFrame, convs: DataFrame, container_turns: int = CONTAINER_TURNS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of conversations (``conv_id, length``) with turns (``conv_id, depth, k1, k2, chars,
    length``): ``conv_id`` (a node's smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` of the subtree, ``ends_sha256``. A conversation without turns is a member
    of the root; without any conversation there is no node. The two sizes change no result."""
    rows, _ = files.written(ordered, "rebuilt_turns")
    xored = _running(rows, "conv_id", {"p1": _mixed("k1", "k2", 1), "p2": _mixed("k2", "k1", 2)}, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    paths, _ = files.written(xored, "paths")
    seqs, _ = files.written(sequences(paths, convs), "sequences")
    heads, _ = files.written(place(paths, seqs, container_turns), "heads")

    parent = {"q1": F.col("p1").bitwiseXOR(_mixed("k1", "k2", 1)), "q2": F.col("p2").bitwiseXOR(_mixed("k2", "k1", 2))}
    placed, _ = files.written(
        paths.withColumnRenamed("conv_id", "seq")
        .join(heads.drop("length"), "seq")
        .withColumn("ends", F.when(F.col("depth") == F.col("length"), F.col("ends"))),
        "placed",
    )
    key = ["depth", "p1", "p2"]
    zero = F.lit(0).cast("bigint")
    at_root = heads.select(
        "seq", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("q1"), zero.alias("q2"), zero.alias("chars"),
        "w", "hd", "length", F.when(F.col("length") == 0, F.col("ends")).alias("ends"),
    )
    head_rows = placed.filter("depth <= hd").withColumns(parent).select(at_root.columns).unionByName(at_root)
    nodes, _ = files.written(
        head_rows.groupBy(*key).agg(
            F.min("seq").alias("conv_id"), F.sum("w").alias("n_convs"), F.max("chars").alias("chars"),
            F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("ends").alias("ends"),
        ),
        "head_nodes",
    )

    hanging = heads.agg(F.sum(F.col("length") - F.col("hd"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("hd", "c1", "c2"), F.lit(-(-hanging // shard_turns) or 1))
    contained = placed.filter("depth > hd").select(
        "seq", "depth", "hd", "c1", "c2", "k1", "k2", "chars", "w", "ends", shard.alias("shard")
    )
    swept, _ = files.written(contained.groupBy("shard").applyInArrow(sweep, _SWEPT), "swept")

    containers = swept.filter("NOT is_node")
    children = (
        containers.select(F.col("hd").alias("depth"), F.col("c1").alias("p1"), F.col("c2").alias("p2"), "n_children")
        .unionByName(nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.lit(1).cast("bigint").alias("n_children")))
        .groupBy(*key)
        .agg(F.sum("n_children").alias("n_children"))
    )
    counted = nodes.join(children, key, "left").fillna(0, ["n_children"])
    # what subtrees sum up: each head's and container's share, at its place on the path of its smallest member
    shares = (
        counted.select("conv_id", "depth", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
        .unionByName(containers.select("conv_id", "depth", "n_leaves", "saved_tokens"))
        .groupBy(F.col("conv_id").alias("seq"), "depth")
        .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    )
    climbing = head_rows.select("seq", *key, F.col("hd").alias("length")).join(shares, ["seq", "depth"], "left").fillna(0, ["n_leaves", "saved_tokens"])
    summed = _running(
        climbing, "seq", {"n_leaves": F.col("n_leaves"), "saved_tokens": F.col("saved_tokens")}, F.sum, lambda a, b: a + b, down=True
    )
    totals = summed.groupBy(*key).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    under = ["depth", "q1", "q2"]
    own = counted.join(totals, key).join(parents, under, "left").select(*_NODES, F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"))
    inner = swept.filter("is_node")
    is_top = F.col("depth") == F.col("hd") + 1
    tops = inner.filter(is_top).drop("parent_conv_id").withColumnsRenamed({"c1": "q1", "c2": "q2"}).join(parents, under)
    columns = [*_NODES, "ends_sha256"]
    return own.unionByName(tops.select(columns)).unionByName(inner.filter(~is_top).select(columns))
