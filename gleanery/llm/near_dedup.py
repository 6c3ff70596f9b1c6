"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

A text becomes the set of its distinct shingles and a signature of 64 minwise hashes. Equal sets are one class.
Classes are then branched into trees: a tree's root deals the classes by a few minwise tokens (the more, the more
classes there are, so that texts alike by chance do not meet); a node of more than `LIMIT` classes is dealt again by `STEP` further
tokens chosen by a hash of the path, into `BRANCH` children (one over the similarity for each token), and so on
down. Small nodes are compared exhaustively by signatures; whatever could reach the similarity (six standard deviations
below it, and sizes that allow it) is confirmed on the full sets of shingles. With three tokens a root keeps
a link of similarity 0.8 with odds of 0.51 and eighteen independent trees miss it with 3 in a million; behind one step it
is 2 in ten thousand, and behind `DEPTH` steps everything is compared.

Large nodes do not wait until branching has split them, which groups of near copies never let it do: their
classes are dealt into chunks that each hold the node's smallest class as pivot, and chunks are
compared like small nodes, so that a member meets hundreds of others in every tree and step. After every step classes confirmed
to be connected share a label; nodes whose classes share one label are done, and pairs with one label are not
compared again. What is still large and mixed after `DEPTH` steps is compared in pairs of blocks, but for those
within its most frequent label, so nothing is lost to a cap. A large node in which
few rows have another label than most is compared so at once, and not branched further. The roots of two trees are compared first, so all trees, these two again, begin with
most groups of copies known.

Links within a cluster leave it as a star of labels, and only labels that new links touch are solved anew, so
a group of n copies gives at most n rows per tree and never n squared.

Defined cases: a text without words, null or empty, has an empty set and is linked with nothing. A text of fewer words than a
shingle has its whole sequence as one. Rows with equal ids are each compared; component ids are the smallest
id that is not null. Extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm.common import bucketed, mix64, partitions, random_words, slices, stored, table, text_or_empty
from gleanery.llm.components import components

HASHES, LIMIT = 64, 512
#: Trees whose roots are compared first, without further steps, so that all trees begin with most groups of copies known.
FIRST = 2
#: A root takes so many tokens that about MEET texts, which share the part CHANCE of their shingles by chance, meet in a node; there are so many
#: trees that all roots part a pair just similar enough with odds of MISS.
CHANCE, MEET, MISS = 1 / 30, 16, 5e-6
#: Tokens of the path that a step of a large node takes at once, and its branches: about (1 / 0.8) ** STEP, the least that keeps links of
#: similarity 0.8 together on average. Steps before what is left is compared exhaustively.
STEP, BRANCH, DEPTH = 3, 2, 2
#: Shingles of a cluster that are held at once when it is confirmed.
TOKENS = 4_000_000
#: Standard deviations that a signature may fall short. At 0.8 at least 32 of 64 hashes must agree, which a link of that
#: similarity misses with odds of 1 in 51 millions (exact binomial tail); more trees do not make up for that, so it is small.
SLACK = 6
_A = (random_words(21, HASHES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (random_words(22, HASHES) >> np.uint64(32)).astype(np.uint32)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; `text` in UTF-8."""
    parts = text.lower().split()  # both know ASCII only
    if not parts:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(each) - words + 1)
    out = np.full(n, min(words, len(each)), np.uint64)
    for k in range(min(words, len(each))):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n])
    return np.unique(out)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise hashes, one row for each set that is not empty (others are 0)."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    start = 0
    while start < len(full):
        stop, held = start, 0
        while stop < len(full) and (held < 40_000 or stop == start):
            held += len(sets[full[stop]])
            stop += 1
        at = full[start:stop]
        joined = np.concatenate([sets[i] for i in at])
        low, high = joined.astype(np.uint32), (joined >> np.uint64(32)).astype(np.uint32)
        heads = np.cumsum([0, *(len(sets[i]) for i in at[:-1])])
        for k in range(HASHES):
            out[at, k] = np.minimum.reduceat((low if k % 2 else high) * _A[k] + _B[k], heads)
        start = stop
    return out


def _sets_table(docs: DataFrame, id_column: str, text_column: str, words: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, row, n, f1, f2, sig, packed): size, fingerprint and signature of every text's set, and the text; in buckets of row."""
    columns = F.struct(*[F.col(f"`{k}`") for k in keep]) if keep else F.lit(0)  # apart from what stands beside them
    other = F.struct(columns.alias("columns"), F.col(f"`{text_column}`").isNull().alias("no_text"))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), other.alias("keep"), text_or_empty(text_column).cast("binary").alias("text"))
    kind, kept = (rows.schema[x].dataType.simpleString() for x in ("id", "keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            sets = [shingle_set(t, words) for t in texts]
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * HASHES, pa.int32()), pa.array(_signatures(sets).astype(np.int32).reshape(-1)))
            prints = [[int(mix64(s ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for salt in (0x5851F42D, 0x14057B7E)]
            made = [pa.array([len(s) for s in sets], pa.int64()), *[pa.array(x, pa.int64()) for x in prints], sig, pa.array([packer.compress(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("keep"), *made], names=["id", "keep", "n", "f1", "f2", "sig", "packed"])

    made = rows.mapInArrow(run, f"id {kind}, keep {kept}, n long, f1 long, f2 long, sig array<int>, packed binary")
    return bucketed(made.withColumn("row", F.monotonically_increasing_id()), "near-sets", "row")


def _least(percent: int) -> float:
    """Equal hashes that two signatures must have to be suspects."""
    share = percent / 100
    return HASHES * share - SLACK * np.sqrt(HASHES * share * (1 - share))


def _pairs(group: np.ndarray, label: np.ndarray, size: np.ndarray, brief: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of rows in one group (rows sorted by it) that may reach the similarity."""
    least = _least(percent)
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.append(heads, len(group)))
    left = np.repeat(heads + sizes, sizes) - np.arange(len(group)) - 1  # rows of the group behind each row
    at, a, b = np.flatnonzero(left > 0), [], []
    for apart in range(1, int(sizes.max(initial=1))):
        at = at[left[at] >= apart]
        for part in range(0, len(at), 1 << 16):
            i = at[part : part + (1 << 16)]
            j = i + apart
            ok = (label[i] != label[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
            i, j = i[ok], j[ok]
            ok = (brief[i] == brief[j]).sum(1) >= least
            a.append(i[ok])
            b.append(j[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _groups(batches: Iterator[pa.RecordBatch], key: str, least_rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key, at least `least_rows` rows but at the end."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < least_rows:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last group may go on
        if cut:
            yield whole.slice(0, cut)
            held = whole.slice(cut).combine_chunks().to_batches()
            count = sum(b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(mine: int, part: np.ndarray, size: np.ndarray, brief: np.ndarray, percent: int, least: float) -> np.ndarray:
    """Places before `mine` that are not yet connected with it and may reach the similarity."""
    small, large = np.minimum(size[:mine], size[mine]), np.maximum(size[:mine], size[mine])
    close = np.flatnonzero((part[:mine] != part[mine]) & (100 * small >= percent * large))
    return close[(brief[close] == brief[mine]).sum(1) >= least]


def _connected(texts: pa.ChunkedArray, label: np.ndarray, size: np.ndarray, brief: np.ndarray, words: int, percent: int) -> np.ndarray:
    """Of every member of a cluster the smallest place it is connected with, by comparing full sets.

    A member is held against all before it at once: its shingles are marked and the marks counted in each of their sets.
    """
    unpack, least = zstandard.ZstdDecompressor(), _least(percent)
    _, first, back = np.unique(label, return_index=True, return_inverse=True)
    part = first[back]  # members of one label are connected from the start
    whole = int(size.sum()) <= TOKENS
    held: dict[int, np.ndarray] = {}

    def full_set(x: int) -> np.ndarray:
        if x not in held:
            if not whole and sum(map(len, held.values())) > TOKENS:
                held.clear()
            held[x] = shingle_set(unpack.decompress(texts[x].as_py()), words)
        return held[x]

    if whole:
        ids = np.unique(np.concatenate([full_set(x) for x in range(len(size))]), return_inverse=True)[1]
        starts = np.cumsum(size) - size
        marks = np.zeros(int(ids.max()) + 1, bool)
    for y in range(1, len(size)):
        close = _open_pairs(y, part, size, brief, percent, least)
        if not len(close):
            continue
        if whole:
            own = ids[starts[y] : starts[y] + size[y]]
            marks[own] = True
            common = np.add.reduceat(marks[ids[: starts[y]]], starts[:y], dtype=np.int64)[close]
            marks[own] = False
        else:
            common = np.array([len(np.intersect1d(full_set(y), full_set(x), assume_unique=True)) for x in close.tolist()])
        same = close[100 * common >= percent * (size[close] + size[y] - common)]
        if len(same):
            joined = np.unique(part[np.append(same, y)])
            part[np.isin(part, joined)] = joined[0]
    return part


class Join:
    """State of one run: the classes, their labels so far, and how to compare groups of classes."""

    def __init__(self, sets: DataFrame, words: int, percent: int) -> None:
        self.sets, self.words, self.percent = sets, words, percent
        # The low bits of a least hash are as good as random; its high ones are zero.
        brief = F.transform("sig", lambda h: F.substring(F.hex(h.bitwiseAND(F.lit(255)).cast("long") + 256), 2, 2))
        first = sets.where("n > 0").groupBy("f1", "f2").agg(F.min("row").alias("c"), F.min("id").alias("cid"))
        whole = first.join(sets.select(F.col("row").alias("c"), "n", "sig").hint("merge"), "c").withColumn("brief", F.unhex(F.array_join(brief, "")))
        self.classes = bucketed(whole, "near-classes", "c")
        # Tokens of a root, and trees.
        self.root = max(1, math.ceil(math.log(max(1, self.classes.count()) / MEET) / -math.log(CHANCE)))
        self.many = max(2, math.ceil(math.log(MISS) / math.log(max(1e-9, 1 - (percent / 100) ** self.root))))
        self.labels: DataFrame | None = None  # (c, label) of classes known to be connected with a smaller one

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows with `label`, the smallest class known to be connected with c."""
        if self.labels is None:
            return rows.withColumn("label", F.col("c"))
        return rows.join(self.labels.withColumnRenamed("label", "known"), "c", "left").withColumn("label", F.coalesce("known", "c")).drop("known")

    def connect(self, links: DataFrame) -> None:
        """Take links (a, b) between labels into the labels; only what they touch is solved anew."""
        if links.isEmpty():
            return
        moved = components(links, "a", "b", "near-components").select(F.col("v").alias("label"), F.col("u").alias("to"))
        fresh = moved.select(F.col("label").alias("c"), F.col("to").alias("label"))
        if self.labels is not None:
            held = self.labels.join(moved, "label", "left").select("c", F.coalesce("to", "label").alias("label"))
            fresh = held.unionByName(fresh)
        self.labels = stored(fresh, "near-labels")

    def similar(self, groups: DataFrame) -> None:
        """Connect the classes confirmed to be similar within groups (g, c, label) of at most LIMIT classes.

        Suspects that hang together in a group are a cluster; their texts meet in one task and are confirmed on full sets.
        """
        about = groups.join(self.classes.select("c", F.col("n").alias("size"), "brief").hint("merge"), "c")
        percent, words = self.percent, self.words
        fields = ["key", "c", "label", "size", "brief"]

        def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _groups(batches, "g", 20_000):
                group, c, label, size = (rows.column(x).to_numpy() for x in ("g", "c", "label", "size"))
                brief = np.frombuffer(b"".join(rows.column("brief").to_pylist()), np.uint8).reshape(-1, HASHES)
                i, j = _pairs(group, label, size, brief, percent)
                if not len(i):
                    continue
                root = np.arange(len(c))
                while True:  # smallest place reachable over the pairs
                    low = np.minimum(root[i], root[j])
                    new = root.copy()
                    np.minimum.at(new, i, low)
                    np.minimum.at(new, j, low)
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                key = mix64(group[root].astype(np.uint64) ^ mix64(c[root].astype(np.uint64)))
                many = np.bincount(root, minlength=len(c))[root] > 1
                made = [pa.array(x) for x in (key[many].astype(np.int64), c[many], label[many], size[many])]
                yield pa.RecordBatch.from_arrays([*made, pa.array([x.tobytes() for x in brief[many]], pa.binary())], names=fields)

        parts = partitions(groups.sparkSession)
        dealt = about.select("g", "c", "label", "size", "brief").repartition(parts, "g").sortWithinPartitions("g", "c")
        guessed = stored(dealt.mapInArrow(guess, "key long, c long, label long, size long, brief binary"), "near-guesses")
        if guessed.isEmpty():
            return
        # A cluster with the same members in several trees is confirmed once.
        once = guessed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"))
        once = once.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
        clusters = guessed.join(once, "key", "left_semi")
        texts = self.sets.select(F.col("row").alias("c"), "packed").hint("merge")  # stay in their buckets
        full = clusters.join(texts, "c").select(*fields, "packed").repartition(parts, "key").sortWithinPartitions("key", "c")

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _groups(batches, "key", 1):
                keys, label, size = (rows.column(x).to_numpy() for x in ("key", "label", "size"))
                brief = np.frombuffer(b"".join(rows.column("brief").to_pylist()), np.uint8).reshape(-1, HASHES)
                heads = np.append(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)).tolist()
                links = []
                for a, b in zip(heads, heads[1:]):
                    part = _connected(rows.column("packed").slice(a, b - a), label[a:b], size[a:b], brief[a:b], words, percent)
                    ends = np.column_stack([label[a:b][part], label[a:b]])
                    links.append(np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0))
                found = np.concatenate(links)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], names=["a", "b"])

        self.connect(stored(full.mapInArrow(confirm, "a long, b long").distinct(), "near-links"))

    def trees(self, many: int, depth: int) -> None:
        """Connect what the first `many` trees find, followed from their roots down, large nodes for at most `depth` steps."""
        tokens = self.classes.select("c", "sig")
        drawn = [random.Random(t).sample(range(HASHES), self.root) for t in range(many)]
        node = F.array(*[F.xxhash64(F.lit(t), *[F.element_at("sig", i + 1) for i in places]) for t, places in enumerate(drawn)])
        rows = tokens
        for level in range(depth + 1):
            rows = stored(self.labelled(rows).select(F.explode(node).alias("node"), "c", "label"), "near-nodes")
            about = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c")).groupBy("node")
            about = about.agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("m", "label")).alias("top"), F.min(F.struct("c", "label")).alias("pivot"))
            about = about.where("labels > 1").select("node", "n", "pivot", F.col("top.label").alias("crowd"), (F.col("n") - F.col("top.m")).alias("others"))
            about = stored(about, "near-sizes")
            live = rows.join(about, "node")
            small = live.where(F.col("n") <= LIMIT).select(F.col("node").alias("g"), "c", "label")
            # Few others than one label's rows are held against all of these at once, and the node is done.
            done = (F.col("n") > LIMIT) & ((F.col("others") <= LIMIT // 2) | F.lit(level >= DEPTH))
            branched = (F.col("n") > LIMIT) & ~done
            large, heads = live.where(branched), about.where(branched)
            chunks = F.ceil(F.col("n") / (LIMIT - 1))
            mine = F.pmod(F.xxhash64("c", F.lit(level)), chunks)
            dealt = large.where("c != pivot.c").select(F.xxhash64("node", mine).alias("g"), "c", "label")
            pivots = heads.select("node", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("k"))
            apart = dealt.union(pivots.select(F.xxhash64("node", "k").alias("g"), "pivot.c", "pivot.label")).union(_blocks(live.where(done)))
            self.similar(small.union(apart))
            if level == depth or heads.isEmpty():
                return
            token = lambda k, i: F.element_at("sig", F.pmod(F.xxhash64("node", F.lit(k), F.lit(i)), F.lit(HASHES)).cast("int") + 1)
            node = F.array(*[F.xxhash64("node", F.lit(k), *[token(k, i) for i in range(STEP)]) for k in range(BRANCH)])
            rows = large.select("node", "c").join(tokens.hint("merge"), "c")


def _blocks(rows: DataFrame) -> DataFrame:
    """Groups (g, c, label) in which every two rows (node, n, crowd, others, c, label) of a node meet, but those of its most frequent label.

    That label's rows (the crowd) and the others are cut into blocks; each block of others meets each block of both.
    """
    size = LIMIT // 2
    met = rows.withColumns({"same": F.col("label") == F.col("crowd"), "a": F.ceil((F.col("n") - F.col("others")) / size), "o": F.ceil(F.col("others") / size)})
    mine = F.pmod(F.xxhash64("c", F.lit(99)), F.when(F.col("same"), F.col("a")).otherwise(F.col("o")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    group = lambda kind, x, y: F.xxhash64("node", F.lit(kind), x, y)
    met = met.withColumn("k", mine)
    crowd = F.transform(upto("o"), lambda j: group(0, F.col("k"), j))
    others = F.concat(F.transform(upto("a"), lambda i: group(0, i, F.col("k"))), F.transform(upto("o"), lambda j: group(1, F.least("k", j), F.greatest("k", j))))
    return met.select(F.explode(F.when(F.col("same"), crowd).otherwise(others)).alias("g"), "c", "label")


def _found(sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, row, n_shingles, component_id, component) of every row of a sets table; `component` is unique, whatever the ids."""
    join = Join(sets, words, percent)
    join.trees(FIRST, 0)
    join.trees(join.many, DEPTH)
    found = join.labelled(join.classes.select("f1", "f2", "c", "cid"))
    least = found.groupBy("label").agg(F.min("cid").alias("component_id"))
    found = stored(found.join(least, "label").select("f1", "f2", "component_id", "label"), "near-found")
    rows = sets.select("id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("f1")).alias("f1"), "f2").join(found, ["f1", "f2"], "left")
    linked = F.col("n_shingles") > 0
    return rows.select("id", "row", "n_shingles", F.when(linked, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.when(linked, F.col("label")).alias("component"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles and component_id (the smallest id connected with it)."""
    found = _found(_sets_table(docs, id_column, text_column, words), words, percent)
    return found.select(F.col("id").alias(id_column), "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: of each component its smallest id, of rows with that id the first."""
    keep = tuple(c for c in docs.columns if c != text_column)
    sets = _sets_table(docs, id_column, text_column, words, keep)
    found = stored(_found(sets, words, percent).where("component IS NOT NULL").select("row", "component", F.struct(~F.col("id").eqNullSafe(F.col("component_id")), "row").alias("rank")), "near-ranks")
    stays = found.groupBy("component").agg(F.min("rank").alias("rank"))
    goes = found.join(stays.select("component", F.col("rank.row").alias("first")), "component").where("row != first").select("row")
    rows = sets.select("row", "keep", "packed").join(stored(goes, "near-goes"), "row", "left_anti").select("keep", "packed")
    return unpacked(rows, docs, text_column)


def unpacked(rows: DataFrame, docs: DataFrame, text_column: str) -> DataFrame:
    """Rows (keep, packed) as rows of docs: the kept columns, apart from whether there was a text, and the text out of its zstandard frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, "packed", 2 << 20):
            texts = pa.array([unpack.decompress(x).decode("utf-8", "ignore") for x in batch.column("packed").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("keep"), texts], names=["keep", "text"])

    made = rows.mapInArrow(run, f"keep {rows.schema['keep'].dataType.simpleString()}, text string")
    text = F.when(~F.col("keep")["no_text"], F.col("text"))
    return made.select(*[text.alias(c) if c == text_column else F.col("keep")["columns"][c].alias(c) for c in docs.columns])


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at 0.8 of their two-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
