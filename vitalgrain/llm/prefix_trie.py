"""Conversation prefix tries as level-order bit vectors, with rollups per node.

1. Rows are dealt by family (a conversation and the one that it takes its opening from), put in order and
   passed through a task as a stream that rebuilds each conversation and chains digests of its turns: the
   digest at depth d names the node. Texts stay behind; a turn is 20 bytes from here on.
2. Conversations with one sequence become one row with a count and the smallest id.
3. Nodes that more than ``heavy`` distinct sequences pass are the upper levels (the root is one always).
   There are at most ``MOST_UPPER`` of them, as ``heavy`` grows with the turns beyond that, so they are a
   table of bounded size that tasks get as a whole.
4. Below them each sequence belongs to one prefix shard, which holds at most ``heavy`` sequences. Numpy builds
   tries in level order (LOUDS: per node a 1 for each child, then a 0) with an array of labels; parents
   and degrees come from the bits, and leaves and savings roll up level by level from the back by add.at.
   Small shards share a build.
5. The shards' tops are summed per parent, and the upper levels are built and rolled up by themselves.
6. Ids that end in a node are hashed in ascending order: blocks of at most 65,536 ids become strings in
   parallel, and a node's blocks pass a task as a stream.

Bounds: one conversation's chain is a row (20 bytes a turn), and a build holds ``heavy`` sequences or about
``BUILD`` turns, whichever is more. A group of copies, however large, is one row from step 2 on.

Defined results: turns go by (turn, role, SHA-256 of the text), null turns first; a null role or text is
empty; rows of a null conversation id take no part (there is no smallest member of none); repeated rows are
turns of their own; an empty table gives no nodes; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrain.llm.common import materialize, small_batches, work_dir

WORD = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)
FAMILY, OPENINGS = 20, 4  # conversations c - c % 20 lend crc32(c) % 4 turns
MOST_UPPER = 100_000
BUILD = 200_000
BLOCK = 1 << 16


class Louds:
    """A trie in level order: ``bits`` (1 per child, then 0, for each node), ``labels`` of all nodes but the first."""

    def __init__(self, bits: np.ndarray, labels: np.ndarray):
        self.bits, self.labels = bits, labels

    @classmethod
    def build(cls, parents: np.ndarray, labels: np.ndarray, nodes: int) -> Louds:
        """From each node's parent, in level order; node 0 is the root and has none."""
        degrees = np.bincount(parents, minlength=nodes)
        bits = np.ones(len(parents) + nodes, bool)
        bits[np.cumsum(degrees + 1) - 1] = False
        return cls(bits, labels)

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def parents(self) -> np.ndarray:
        """Of the nodes 1, 2, ...: the zeros before the node's 1."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def roll_up(self, levels: list[int], *values: np.ndarray) -> None:
        """Add each node's values to its parent's, from the last level back; ``levels``: where each begins, and the end."""
        parents = self.parents()
        for a, b in zip(levels[-2:0:-1], levels[:1:-1], strict=True):
            for v in values:
                np.add.at(v, parents[a - 1 : b - 1], v[a:b])


def build(paths: list[list[bytes]], own: list[int]):
    """(trie, starts of levels, node of each sequence's turns, first sequence of each node).

    ``paths`` are node digests below a common root; ``own`` gives each sequence's smallest id, by which
    nodes of a level are looked at, so that the first sequence of a node has its smallest member.
    """
    order = np.argsort(np.array(own), kind="stable")
    lengths = np.array([len(p) for p in paths])
    at = np.zeros(len(paths), int)  # node of each sequence at the depth before
    where = [np.zeros(n, int) for n in lengths]
    parents, labels, levels, first, nodes = [], [], [0, 1], [int(order[0]) if len(order) else -1], 1
    live, depth = order, 0
    while len(live := live[lengths[live] > depth]):
        said = np.array([paths[i][depth] for i in live], dtype="S16")
        keys = np.empty(len(live), dtype=[("p", np.int64), ("l", "S16")])
        keys["p"], keys["l"] = at[live], said
        kinds, firsts, back = np.unique(keys, return_index=True, return_inverse=True)
        parents.append(kinds["p"])
        labels.append(kinds["l"])
        first += live[firsts].tolist()
        at[live] = nodes + back
        for i, n in zip(live.tolist(), at[live].tolist(), strict=True):
            where[i][depth] = n
        nodes += len(kinds)
        levels.append(nodes)
        depth += 1
    flat = np.concatenate(parents) if parents else np.zeros(0, int)
    return Louds.build(flat, np.concatenate(labels) if labels else np.zeros(0, "S16"), nodes), levels, where, np.array(first)


def opening(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % OPENINGS


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, nodes, words): each rebuilt conversation's node digests from depth 1 on, and the words of its turns."""
    import pyarrow as pa

    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lent = F.col(conv) - F.col(conv) % FAMILY
    small = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), lent.cast("long").alias("family"), F.col(turn).alias("turn"), said(role).alias("role"), F.sha2(said(text), 256).alias("digest"),
        F.size(F.regexp_extract_all(said(text), F.lit(WORD), F.lit(0))).alias("words"),
    )
    small_batches(rows.sparkSession, 10_000)
    columns = ["family", "conv_id", "role", "digest", "words"]

    def run(batches):
        family, lender, conv, state, made = None, [], None, None, ([], [], [])

        def close():
            for out, v in zip(made, (conv, state["nodes"], state["words"]), strict=True):
                out.append(v)

        def say(label: bytes, words: int) -> None:
            state["last"] = hashlib.sha256(state["last"] + label).digest()[:16]
            state["nodes"].append(state["last"])
            state["words"].append(words)

        def full():
            arrays = [pa.array(made[0], pa.int64()), pa.array(made[1], pa.list_(pa.binary())), pa.array(made[2], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "nodes", "words"])

        for batch in batches:
            for fam, c, r, digest, words in zip(*(batch.column(x).to_pylist() for x in columns), strict=True):
                if c != conv or state is None:
                    if state is not None:
                        close()
                    if fam != family:
                        family, lender = fam, []
                    conv, state = c, {"last": ROOT, "nodes": [], "words": [], "skip": opening(c), "at": 0}
                    if c != fam:
                        for label, n in lender[: state["skip"]]:
                            say(label, n)
                label = hashlib.sha256(f"{len(r)}:{r}{digest}".encode("utf-8", "surrogatepass")).digest()
                if c == fam and len(lender) < OPENINGS - 1:
                    lender.append((label, words))
                state["at"] += 1
                if c == fam or state["at"] > state["skip"]:
                    say(label, words)
            if len(made[0]) >= 1000:
                yield full()
                made = ([], [], [])
        if state is not None:
            close()
            yield full()

    # the lending conversation goes first in its family
    dealt = small.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.asc_nulls_first("turn"), "role", "digest")
    return dealt.select(*columns).mapInArrow(run, "conv_id long, nodes array<binary>, words array<int>")


def ends(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes in which conversations end."""
    import pyarrow as pa

    last = paths.select(F.coalesce(F.try_element_at("nodes", F.lit(-1)), F.lit(ROOT)).alias("node"), "conv_id")
    blocks = last.groupBy("node", F.floor(F.col("conv_id") / F.lit(BLOCK)).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def run(batches):
        node, digest, made = None, None, []
        for batch in batches:
            for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if n == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    made.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256(ids.encode())
            if len(made) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.binary(), pa.string()), strict=True)], ["node", "ends_sha256"])
                made = []
        if node is not None:
            made.append((node, digest.hexdigest()))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.binary(), pa.string()), strict=True)], ["node", "ends_sha256"])

    return blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


NODE = "node binary, conv_id long, depth long, parent binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _batch(rows: dict):
    import pyarrow as pa

    kinds = {"node": pa.binary(), "parent": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(rows[c], kinds.get(c, pa.int64())) for c in rows], list(rows))


def _shard_rows(group: list[tuple], lend: dict[bytes, tuple[int, int]]):
    """Nodes of the tries of some shards: sequences (skip, nodes, words, n, conv_id), of which ``skip`` nodes are upper ones."""
    below = [nodes[skip:] for skip, nodes, *_ in group]
    trie, levels, where, first = build(below, [g[4] for g in group])
    nodes = len(first)
    convs, words = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    for (skip, _, w, n, _), spots in zip(group, where, strict=True):
        convs[spots] += n
        words[spots] = w[skip:]
    degrees = trie.degrees()
    leaves, saved = (degrees == 0).astype(np.int64), (convs - 1) * words
    trie.roll_up(levels, leaves, saved)
    parents = np.concatenate([[0], trie.parents()])
    starts = np.searchsorted(np.array(levels), np.arange(nodes), side="right") - 1  # level of each node
    ids = np.array([g[4] for g in group])
    made = {k: [] for k in ("node", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")}
    for k in range(1, nodes):
        skip, path = group[first[k]][:2]
        depth = skip + int(starts[k])
        parent = path[depth - 2] if depth > 1 else ROOT
        made["node"].append(path[depth - 1])
        made["parent"].append(parent)
        made["depth"].append(depth)
        made["parent_conv_id"].append(lend[parent][0] if starts[k] == 1 else int(ids[first[parents[k]]]))
    made["conv_id"], made["n_convs"], made["n_children"] = ids[first[1:]], convs[1:], degrees[1:]
    made["n_leaves"], made["saved_tokens"] = leaves[1:], saved[1:]
    return _batch(made)


def shards(sequences: DataFrame, upper: dict[bytes, tuple[int, int]]) -> DataFrame:
    """Nodes below the upper levels; ``upper``: (smallest member, members) by digest, of bounded size."""
    held = sequences.sparkSession.sparkContext.broadcast(upper)

    def tagged(batches):
        import pyarrow as pa

        for batch in batches:
            skips, tops = [], []
            for nodes in batch.column("nodes").to_pylist():
                k = 0
                while k < len(nodes) and nodes[k] in held.value:
                    k += 1
                skips.append(k)
                tops.append(nodes[k] if k < len(nodes) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(skips, pa.int32()), pa.array(tops, pa.binary())], [*batch.schema.names, "skip", "top"])

    def run(batches):
        group, size, top = [], 0, None
        for batch in batches:
            for t, *row in zip(*(batch.column(c).to_pylist() for c in ("top", "skip", "nodes", "words", "n", "conv_id")), strict=True):
                if t != top and size >= BUILD:
                    yield _shard_rows(group, held.value)
                    group, size = [], 0
                top = t
                group.append(tuple(row))
                size += len(row[1]) - row[0]
        if group:
            yield _shard_rows(group, held.value)

    kind = "nodes array<binary>, words array<int>, n long, conv_id long, skip int, top binary"
    cut = sequences.select("nodes", "words", "n", "conv_id").mapInArrow(tagged, kind).where("top IS NOT NULL")
    return cut.repartition("top").sortWithinPartitions("top", "conv_id").mapInArrow(run, NODE)


def _upper_rows(rows: list[dict]):
    """The upper levels: rows (node, parent, depth, conv_id, n_convs, words, tops, top_leaves, top_saved) of all their nodes."""
    rows = sorted(rows, key=lambda r: r["depth"])
    spot = {r["node"]: i for i, r in enumerate(rows)}
    rank, order = {ROOT: 0}, [spot[ROOT]]
    levels, at = [0, 1], 1
    while at < len(rows):  # level order: by parent's place, then label
        depth = rows[at]["depth"]
        end = at
        while end < len(rows) and rows[end]["depth"] == depth:
            end += 1
        for i in sorted(range(at, end), key=lambda i: (rank[rows[i]["parent"]], rows[i]["node"])):
            rank[rows[i]["node"]] = len(order)
            order.append(i)
        levels.append(len(order))
        at = end
    some = [rows[i] for i in order]
    trie = Louds.build(np.array([rank[r["parent"]] for r in some[1:]], int), np.array([r["node"] for r in some[1:]], "S16"), len(some))
    col = lambda k: np.array([r[k] or 0 for r in some], np.int64)
    degrees = trie.degrees() + col("tops")
    leaves, saved = (degrees == 0) + col("top_leaves"), (col("n_convs") - 1) * col("words") + col("top_saved")
    trie.roll_up(levels, leaves, saved)
    parents = trie.parents()
    return _batch({
        "node": [r["node"] for r in some], "conv_id": col("conv_id"), "depth": col("depth"), "parent": [r["parent"] for r in some],
        "parent_conv_id": [None, *(some[p]["conv_id"] for p in parents.tolist())], "n_convs": col("n_convs"), "n_children": degrees, "n_leaves": leaves, "saved_tokens": saved,
    })


def trie(rows: DataFrame, heavy: int = 1_000, **names: str) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = rows.sparkSession
    at = work_dir(spark, "trie")
    paths = materialize(chains(rows, **names), f"{at}/paths")
    same = F.coalesce(F.try_element_at("nodes", F.lit(-1)), F.lit(ROOT)).alias("last")
    sizes = paths.groupBy(same).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    sequences = materialize(sizes.join(paths.select("conv_id", "nodes", "words"), "conv_id"), f"{at}/sequences")
    turns = sequences.agg(F.sum(F.size("nodes"))).head()[0] or 0
    bound = max(heavy, -(-turns // MOST_UPPER))
    # a node's parent and words are the same wherever it stands
    steps = sequences.select("n", "conv_id", F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("words")).union(
        sequences.select("n", "conv_id", F.arrays_zip("nodes", F.concat(F.array(F.lit(ROOT)), F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0)))).alias("parents"), "words").alias("z"))
        .select("n", "conv_id", F.posexplode("z").alias("d", "z"))
        .select("n", "conv_id", "z.nodes", "z.parents", F.col("d") + 1, "z.words")
    )
    upper = materialize(
        steps.groupBy("node").agg(F.count("*").alias("paths"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), F.max("depth").cast("long").alias("depth"), F.max("words").cast("long").alias("words"))
        .where((F.col("paths") > bound) | (F.col("node") == F.lit(ROOT))).drop("paths"),
        f"{at}/upper",
    )
    known = {bytes(r.node): (r.conv_id, r.n_convs) for r in upper.select("node", "conv_id", "n_convs").collect()}
    low = materialize(shards(sequences, known), f"{at}/nodes")
    tops = low.join(F.broadcast(upper.select(F.col("node").alias("parent"))), "parent").groupBy("parent").agg(
        F.count("*").alias("tops"), F.sum("n_leaves").alias("top_leaves"), F.sum("saved_tokens").alias("top_saved")
    )
    joined = upper.join(tops.withColumnRenamed("parent", "node"), "node", "left")

    def merge(batches):
        found = [r for b in batches for r in b.to_pylist()]
        if found:
            yield _upper_rows(found)

    high = joined.repartition(1).mapInArrow(merge, NODE)
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        low.unionByName(high).join(ends(paths), "node", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    )

