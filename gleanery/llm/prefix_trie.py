"""Conversation prefix trie by ternary search trees over dictionary-encoded turns.

1. *Turns*: each row's place in its conversation comes from one range-sorted numbering of all rows; role and text become a
   digest in the scan, and distinct digests a dictionary of dense ids. Texts are never shuffled.
2. *Blocks*: a conversation is cut into blocks of `BLOCK` turns, so none is gathered whole. A block starts under the digest of all turns before
   it. Equal blocks are one item with a count, its smallest conversation, and sums.
3. *Shards*: items are dealt by range of (start, ids) and sorted. A task takes up to `ITEMS` at a time into a
   ternary search tree, inserting medians first, which keeps it balanced. Each item knows how many turns it shares with the item
   before it and whether the next one goes on where it ends, across chunks and tasks too (two items per task reach the
   driver). A node is counted where the first item that has it lies, so members, children, leaves and savings
   are sums over items; an iterative traversal adds them up from the leaves.
4. *Boundary nodes*, those that several chunks or blocks hold, are merged by adding their rows.

Savings of a subtree: each node's (members - 1) * characters is the members' turns from there on, less
each node's own characters once. What later blocks add is handed back along the conversation before the traversal.

Defined cases: rows without conv_id belong to no conversation and are left out. Turns of equal number (null first) are
ordered by role, then the text's first 64 characters, then its digest; repeated rows are turns of their own. Null role or text is empty. An empty table has no nodes, not
even a root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gleanery.llm.common import numbered, partitions, stored, table

#: Turns of a conversation held in one row, items of one search tree, conversation ids hashed at once.
BLOCK, ITEMS, IDS = 64, 20_000, 20_000
#: A conversation takes the first crc32(conv_id) % HEADS turns of the one whose id ends in two zeros.
HEADS, FAMILY = 6, 100


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, n): every turn's place in its conversation from 0, the digest of (role, text), code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    # Role and text order rows of one turn number; equal ones are alike, so their digest may stand for them at the end.
    tied = rows.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"), digest.alias("digest"), F.length(text).cast("long").alias("n"))
    placed = numbered(tied, [F.col(c) for c in ("conv_id", "turn", "role", "head", "digest")], "row", "trie-turns")
    first = placed.groupBy("conv_id").agg(F.min("row").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("row") - F.col("first")).alias("pos"), "digest", "n")


def rebuilt(turns: DataFrame) -> DataFrame:
    """The turns of every conversation rebuilt on its family's head: (conv_id, pos, digest, n)."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    ids = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    starts = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS - 1)).select(F.col("conv_id").alias("family"), "pos", "digest", "n")
    taken = F.least(F.col("h"), F.coalesce("held", F.lit(0).cast("long")))
    sizes = starts.groupBy("family").agg(F.count(F.lit(1)).alias("held"))
    convs = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), head.alias("h")).join(sizes, "family", "left").select("conv_id", "family", "h", taken.alias("taken"))
    heads = convs.join(starts, "family").where(F.col("pos") < F.col("h")).select("conv_id", "pos", "digest", "n")
    rest = turns.join(convs, "conv_id").where(F.col("pos") >= F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n")
    return heads.unionByName(rest)


def encoded(turns: DataFrame) -> DataFrame:
    """Turns with the dense id of their digest instead of it."""
    words = numbered(turns.select("digest").distinct(), [F.col("digest")], "id", "trie-words").select("digest", "id")
    return turns.join(words, "digest").select("conv_id", "pos", "id", "n")


def _mixed(seed: int) -> Column:
    """Hash of a turn at its place; a sequence's digest is the exclusive or of these, in two versions."""
    return F.xxhash64(F.col("pos"), F.col("id"), F.lit(seed))


def blocks_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, block, k1, k2 of all turns before it, a, b of its own, turns, chars, on): on says whether another block follows."""
    turns = turns.withColumns({"a": _mixed(1), "b": _mixed(2), "block": F.floor(F.col("pos") / BLOCK).cast("long")})
    every = turns.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("block")), allowMissingColumns=True)
    made = every.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id", "n", "a", "b")))).alias("turns"),
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("chars"),
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return made.select(
        "conv_id", "block", F.coalesce(F.bit_xor("a").over(before), zero).alias("k1"), F.coalesce(F.bit_xor("b").over(before), zero).alias("k2"),
        F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"), "turns", "chars", F.lead("block").over(Window.partitionBy("conv_id").orderBy("block")).isNotNull().alias("on"),
    )


def _items(blocks: DataFrame, name: str) -> DataFrame:
    """Equal blocks as one row, stored in shards by range, each with the turns it shares with the item before it (-1 if not even
    the start, null for the first of a shard) and whether the next begins with it (null for the last of a shard).

    later_: what all members' later blocks add (characters of turns, leaves, characters of nodes).
    """
    field = lambda f: F.transform("turns", lambda t: t[f])
    grouped = blocks.groupBy("block", "k1", "k2", field("id").alias("ids")).agg(
        F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("least"), F.max("on").alias("on"), *[F.min(field(f)).alias(f) for f in ("n", "a", "b")],
        F.sum("later_chars").alias("later_chars"), F.sum("later_leaves").alias("later_leaves"), F.sum("later_own").alias("later_own"),
    )
    order = ["block", "k1", "k2", "ids"]
    dealt = grouped.repartitionByRange(partitions(blocks.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kinds = pa.int64(), pa.bool_()

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict | None = None
        waiting: pa.RecordBatch | None = None  # the batch before, whose last row waits for the next item
        shared: list[int | None] = []

        def done(following: dict | None) -> pa.RecordBatch:
            goes = [s is not None and s == n for s, n in zip(shared[1:], lengths)] + [None if following is None else _shared(last, following) == lengths[-1]]
            return pa.RecordBatch.from_arrays([*waiting.columns, pa.array(shared, kinds[0]), pa.array(goes, kinds[1])], names=[*waiting.schema.names, "shared", "followed"])

        lengths: list[int] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.select(order).to_pylist()
            if waiting is not None:
                yield done(rows[0])
            shared = []
            for row in rows:
                shared.append(None if last is None else _shared(last, row))
                last = row
            waiting, lengths = batch, [len(row["ids"]) for row in rows]
        if waiting is not None:
            yield done(None)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    return stored(dealt.mapInArrow(neighbours, f"{schema}, shared long, followed boolean"), name)


def _shared(a: dict, b: dict) -> int:
    """Turns that b shares with a from their common start; -1 if not even the start."""
    if (a["block"], a["k1"], a["k2"]) != (b["block"], b["k1"], b["k2"]):
        return -1
    n = 0
    for x, y in zip(a["ids"], b["ids"]):
        if x != y:
            break
        n += 1
    return n


class SearchTree:
    """A ternary search tree over sequences of ids; node 0 is the start that all of them share."""

    def __init__(self) -> None:
        self.symbol, self.low, self.equal, self.high, self.above, self.depth = [-1], [0], [0], [0], [0], [0]

    def _new(self, symbol: int, above: int) -> int:
        for column, value in zip((self.symbol, self.low, self.equal, self.high, self.above, self.depth), (symbol, 0, 0, 0, above, self.depth[above] + 1)):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, ids: list[int]) -> list[int]:
        """The nodes of the sequence, the start first."""
        at, path = 0, [0]
        for symbol in ids:
            node = self.equal[at]
            if not node:
                node = self.equal[at] = self._new(symbol, at)
            while self.symbol[node] != symbol:
                side = self.low if symbol < self.symbol[node] else self.high
                if not side[node]:
                    side[node] = self._new(symbol, at)
                node = side[node]
            path.append(node)
            at = node
        return path


def medians(n: int) -> Iterator[int]:
    """0..n-1, the middle first, then the middles of both halves, and so on."""
    waiting = [(0, n)]
    for start, stop in waiting:
        if start < stop:
            middle = (start + stop) // 2
            yield middle
            waiting += [(start, middle), (middle + 1, stop)]


def _tree_rows(items: list[dict]) -> dict[str, list]:
    """The nodes of items under one start, each with sums over its subtree."""
    tree, paths = SearchTree(), [[]] * len(items)
    for i in medians(len(items)):
        paths[i] = tree.insert(items[i]["ids"])
    size = len(tree.symbol)
    members, chars, leaves, own, children, first = ([0] * size for _ in range(6))
    least: list[int | None] = [None] * size
    length, k1, k2 = [0] * size, [0] * size, [0] * size
    k1[0], k2[0] = items[0]["k1"], items[0]["k2"]
    for item, path in zip(items, paths):
        end = path[-1]
        members[end] += item["members"]
        least[end] = item["least"]
        chars[end] += item["later_chars"]
        leaves[end] += item["later_leaves"] + (not item["followed"] and not item["on"])
        own[end] += item["later_own"]
        for node, n, a, b in zip(path[1:], item["n"], item["a"], item["b"]):
            length[node], k1[node], k2[node] = n, a, b
        for node in path[max(1, item["shared"] + 1) :]:  # nodes that no item before has
            first[node] = 1
    order, waiting = [], [0]  # a node before all below it
    while waiting:
        node = waiting.pop()
        order.append(node)
        under = [tree.equal[node]] if tree.equal[node] else []
        for child in under:
            under += [x for x in (tree.low[child], tree.high[child]) if x]
            k1[child] ^= k1[node]
            k2[child] ^= k2[node]
        waiting += under
    for node in reversed(order[1:]):
        up = tree.above[node]
        chars[node] += members[node] * length[node]
        own[node] += first[node] * length[node]
        for column in (members, chars, own, leaves):
            column[up] += column[node]
        children[up] += first[node]
        if least[up] is None or least[node] < least[up]:
            least[up] = least[node]
    start = items[0]["block"] * BLOCK
    rows = {"depth": [start + tree.depth[x] for x in order], "up1": [k1[tree.above[x]] for x in order], "up2": [k2[tree.above[x]] for x in order]}
    rows |= {name: [column[x] for x in order] for name, column in (("k1", k1), ("k2", k2), ("least", least), ("members", members), ("children", children), ("leaves", leaves), ("chars", chars), ("own", own))}
    rows["up1"][0] = rows["up2"][0] = None
    if start:  # the start ends the block before, which has its members and sums already
        for name in ("members", "leaves", "chars", "own"):
            rows[name][0] = 0
        rows["least"][0] = None
    return rows


def _known(items: DataFrame):  # noqa: ANN202
    """A function that fills in what the first and last item of each shard could not see, from two items per shard."""
    edges = items.where(F.col("shared").isNull() | F.col("followed").isNull()).select("part", "block", "k1", "k2", "ids", F.col("shared").isNull().alias("first"), F.col("followed").isNull().alias("last")).collect()
    heads, tails = {r.part: r.asDict() for r in edges if r.first}, {r.part: r.asDict() for r in edges if r.last}
    parts = sorted(heads)
    before, after = dict(zip(parts[1:], parts)), dict(zip(parts, parts[1:]))

    def fill(row: dict) -> dict:
        if row["shared"] is None:
            row["shared"] = _shared(tails[before[row["part"]]], row) if row["part"] in before else -1
        if row["followed"] is None:
            row["followed"] = row["part"] in after and _shared(row, heads[after[row["part"]]]) == len(row["ids"])
        return row

    return fill


def _rows(batches: Iterator[pa.RecordBatch], fill) -> Iterator[list[dict]]:  # noqa: ANN001
    """Runs of up to ITEMS items of one start. Any set will do: all that is counted is a sum over items."""
    held: list[dict] = []
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            for row in map(fill, batch.slice(i, 1024).to_pylist()):
                if held and (len(held) >= ITEMS or any(row[c] != held[0][c] for c in ("block", "k1", "k2"))):
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _nodes(items: DataFrame) -> DataFrame:
    """Rows of nodes; one that several trees hold has a row from each."""
    fill = _known(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _rows(batches, fill):
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in _tree_rows(held).items()})

    return items.mapInArrow(run, ", ".join(f"{c} long" for c in ("depth", "up1", "up2", "k1", "k2", "least", "members", "children", "leaves", "chars", "own")))


def _with_later(blocks: DataFrame) -> DataFrame:
    """Blocks with what their conversation's later blocks add."""
    zero = F.lit(0).cast("long")
    plain = {"later_chars": zero, "later_leaves": zero, "later_own": zero}
    follow = blocks.where("block > 0")
    items = _items(follow.withColumns(plain), "trie-later")
    fill = _known(items)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each item adds by itself, told to its smallest conversation."""
        for held in _rows(batches, fill):
            made = {"conv_id": [x["least"] for x in held], "block": [x["block"] for x in held], "leaves": [int(not x["followed"] and not x["on"]) for x in held]}
            made["own"] = [sum(x["n"][max(0, x["shared"]) :]) for x in held]
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in made.items()})

    own = items.mapInArrow(added, "conv_id long, block long, leaves long, own long")
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    summed = follow.select("conv_id", "block", "chars").join(own, ["conv_id", "block"], "left").select(
        "conv_id", (F.col("block") - 1).alias("block"), F.sum("chars").over(after).alias("later_chars"),
        F.sum(F.coalesce("leaves", zero)).over(after).alias("later_leaves"), F.sum(F.coalesce("own", zero)).over(after).alias("later_own"),
    )
    return blocks.where(~F.col("on")).withColumns(plain).unionByName(blocks.where(F.col("on")).join(summed, ["conv_id", "block"]))


def _end_hashes(blocks: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes where conversations end.

    The order of one node's ids is dealt by range over many tasks, which write runs of ids; the hash itself has to
    read a node's runs in order, one at a time.
    """
    key = ["depth", "k1", "k2"]
    last = blocks.where(~F.col("on")).select(
        (F.col("block") * BLOCK + F.size("turns")).alias("depth"), F.col("k1").bitwiseXOR(F.col("a")).alias("k1"), F.col("k2").bitwiseXOR(F.col("b")).alias("k2"), "conv_id"
    )
    dealt = last.repartitionByRange(partitions(blocks.sparkSession), *key, "conv_id").sortWithinPartitions(*key, "conv_id")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in key]
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for column in columns:
                new[1:] |= column[1:] != column[:-1]
            starts = np.flatnonzero(new)
            starts = np.unique(np.concatenate([starts, np.arange(0, batch.num_rows, IDS)]))
            ids = batch.column("conv_id").to_pylist()
            stops = [*starts[1:].tolist(), batch.num_rows]
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts.tolist(), stops)]
            arrays = [pa.array(c[starts], pa.int64()) for c in columns] + [pa.array([ids[a] for a in starts.tolist()], pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*key, "conv_id", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, made = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([m[i] for m in made], pa.int64()) for i in range(3)], pa.array([m[3] for m in made], pa.string())], names=[*key, "ends_sha256"])

        for batch in batches:
            for *name, ids in zip(*[batch.column(c).to_pylist() for c in key], batch.column("ids")):
                if name == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        made.append((*node, digest.hexdigest()))
                    node, digest = name, hashlib.sha256()
                digest.update(ids.as_py().encode())
            if len(made) > 10_000:
                yield out()
                made.clear()
        if node is not None:
            made.append((*node, digest.hexdigest()))
        if made:
            yield out()

    written = dealt.mapInArrow(runs, "depth long, k1 long, k2 long, conv_id long, ids string")
    return written.repartition(partitions(blocks.sparkSession), *key).sortWithinPartitions(*key, "conv_id").mapInArrow(hashes, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the trie over turns (conv_id, pos, digest, n) of the conversations in convs (conv_id)."""
    blocks = stored(blocks_of(encoded(turns), convs), "trie-blocks")
    key = ["depth", "k1", "k2"]
    parts = _nodes(_items(_with_later(blocks), "trie-items"))
    nodes = stored(
        parts.groupBy(*key).agg(
            F.max("up1").alias("up1"), F.max("up2").alias("up2"), F.min("least").alias("conv_id"), F.sum("members").alias("n_convs"), F.sum("children").alias("n_children"),
            F.sum("leaves").alias("n_leaves"), (F.sum("chars") - F.sum("own")).alias("saved_tokens"),
        ),
        "trie-nodes",
    )
    above = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.join(above, ["depth", "up1", "up2"], "left").join(_end_hashes(blocks), key, "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    turns = stored(ordered_turns(table(spark, sf_dir, "conversations")), "trie-placed")
    return prefix_trie(rebuilt(turns), turns.select("conv_id").distinct())


#: The same nodes in SQL, paths kept whole; crc32 is folded bit by bit over the digits of an id.
OP12_SQL = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64),
            sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS seq FROM turns GROUP BY conv_id),
heads AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
        lambda i: [ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x < 0 THEN xor(c >> 1, (c & 1) * 3988292384) ELSE xor(c, x) END), 4294967295) % 6 AS h
    FROM own
),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(f.seq[1:c.h], []), c.seq[c.h + 1:]) AS seq
    FROM heads c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 100
),
reached AS (SELECT conv_id, len(seq) AS ends, unnest(range(len(seq) + 1)) AS depth, seq FROM rebuilt),
nodes AS (
    SELECT depth, CASE WHEN depth > 0 THEN seq[1:depth] ELSE [] END AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends = depth), '')) AS ends_sha256
    FROM reached GROUP BY 1, 2
),
linked AS (
    SELECT n.*, u.conv_id AS parent_conv_id, CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(n.path[n.depth].text) ELSE 0 END AS saving,
        (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND CASE WHEN n.depth > 0 THEN c.path[1:n.depth] ELSE [] END = n.path) AS n_children
    FROM nodes n LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.path = CASE WHEN n.depth > 1 THEN n.path[1:n.depth - 1] ELSE [] END
),
below AS (SELECT unnest(range(depth + 1)) AS up, path, saving, n_children FROM linked),
summed AS (
    SELECT up AS depth, CASE WHEN up > 0 THEN path[1:up] ELSE [] END AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saving) AS saved
    FROM below GROUP BY 1, 2
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM linked JOIN summed USING (depth, path)
"""
