"""Removal of long repeated byte strings by a hash-compared suffix sort.

A byte goes if it lies in a string of `SPAN` bytes that starts at another place too, in any document or
the same one. Every such window has one anchor: the place of the smallest hash among its grams of
`GRAM` bytes (the leftmost of equal ones). Equal windows have equal anchors at equal distance, so only anchors
whose gram occurs twice can matter, and only with the bytes around them that their own windows cover.

Anchors with one gram hash form a group. Its places are suffix sorted twice, by the bytes from the anchor on
and by the bytes before it, backwards. The sort is a bottom-up mergesort: the longest common extension of two
places is found by binary search over prefix polynomial hashes, so a comparison costs the logarithm of its length.
The extensions of neighbours are then compared byte by byte, and a hash collision is put right. A window that starts
d bytes before its anchor occurs twice if two places share d bytes to the left and SPAN - d to the right: two
interval numbers, read off the sorted orders, that are equal for both.

Places of one batch that have the same bytes around them are duplicates at once, and one of them is sent on. Groups of more than `HOT` places
(a passage that a great part of all documents share) are not gathered: their windows are met by a 128-bit
digest each, again after removing those that repeat within a batch. So no group, however large, is one task's work.

Defined cases: a null text is an empty one. Texts shorter than `SPAN` lose nothing. Repeated rows repeat each
other's bytes, hence both lose them. Null and repeated ids are kept apart. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm.common import mix64, random_words, remembered, slices, stored, table, text_or_empty
from gleanery.llm.near_dedup import _groups

SPAN, GRAM, HOT = 400, 96, 8192
#: Windows handled at once; places within are 23 bits.
PIECE = 1 << 22
_BITS = np.uint64(23)
_BYTE = random_words(41, 256) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Prefix polynomial hashes of a buffer: any substring's hash is one difference."""

    _up = _powers(_BASE, 1)
    _down = _powers(_INVERSE, 1)

    def __init__(self, data: np.ndarray) -> None:
        if len(Hashes._up) < len(data) + 1:
            size = (len(data) >> 16) + 1 << 16
            Hashes._up, Hashes._down = _powers(_BASE, size), _powers(_INVERSE, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * Hashes._up[: len(data)], out=self.sums[1:])

    @staticmethod
    def forget() -> None:
        Hashes._up, Hashes._down = _powers(_BASE, 1), _powers(_INVERSE, 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * Hashes._down[start]


remembered("powers", Hashes.forget)


def anchors(data: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, first and last window of every anchor in texts laid end to end (at most 2^23 bytes)."""
    none = np.zeros(0, np.int64)
    n = len(data) - span + 1
    if n <= 0:
        return none.astype(np.uint64), none, none, none
    width = span - gram + 1
    at = np.arange(len(data) - gram + 1)
    sums = Hashes(data).sums
    grams = mix64((sums[gram:] - sums[: len(data) - gram + 1]) * Hashes._down[: len(data) - gram + 1])
    keys = (grams >> _BITS << _BITS) | at.astype(np.uint64)
    # Smallest key of every run of `width`: the end of one block and the head of the next.
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, ~np.uint64(0))
    padded[: len(keys)] = keys
    head = np.minimum.accumulate(padded.reshape(blocks, width), 1).reshape(-1)
    tail = np.minimum.accumulate(padded.reshape(blocks, width)[:, ::-1], 1)[:, ::-1].reshape(-1)
    least = np.minimum(tail[:n], head[width - 1 : width - 1 + n])
    place = (least & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
    start = np.arange(n)
    owner_end = ends[np.searchsorted(ends, start, "right")]
    start = start[start + span <= owner_end]  # windows that cross texts are none
    if not len(start):
        return none.astype(np.uint64), none, none, none
    place = place[start]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1])])
    last = np.append(first[1:], len(place)) - 1
    return grams[place[first]], place[first], start[first], start[last]


def _extent(hashes: Hashes, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Longest common extension of places a and b, `room` at most, by binary search over hashes."""
    low, high = np.zeros(len(a), np.int64), room.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        same = hashes.of(a, a + mid) == hashes.of(b, b + mid)
        low = np.where(same, mid, low)
        high = np.where(same, high, mid - 1)


def suffix_sort(data: np.ndarray, group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[start:stop] within their groups (rows sorted by group), and the length that
    each shares with the one before it (-1 for the first of a group)."""
    hashes = Hashes(data)
    n = len(start)
    order = np.arange(n)
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.append(heads, n))
    first, after = np.repeat(heads, sizes), np.repeat(heads + sizes, sizes)

    def before(a: np.ndarray, b: np.ndarray, equal: bool) -> np.ndarray:
        """Whether suffix a sorts before suffix b (or with it, if `equal`)."""
        room = np.minimum(stop[a] - start[a], stop[b] - start[b])
        shared = _extent(hashes, start[a], start[b], room)
        done = shared == room
        x, y = data[np.minimum(start[a] + shared, len(data) - 1)], data[np.minimum(start[b] + shared, len(data) - 1)]
        la, lb = stop[a] - start[a], stop[b] - start[b]
        return np.where(done, (la <= lb) if equal else (la < lb), x < y)

    width = 1
    while width < n:  # a group may lie across the boundary of runs of any width
        middle = np.arange(width, n, 2 * width)
        middle = middle[group[middle] == group[middle - 1]]  # other merges would move nothing
        if len(middle):
            left0, right1 = np.maximum(first[middle], middle - width), np.minimum(after[middle], middle + width)
            pieces = []
            for mine0, mine1, other0, other1, is_left in ((left0, middle, middle, right1, True), (middle, right1, left0, middle, False)):
                count = mine1 - mine0
                inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(mine0, count) + inside
                low, high = np.repeat(other0, count), np.repeat(other1, count)
                base, origin = np.repeat(left0, count), low.copy()
                item = order[at]
                while True:
                    todo = np.flatnonzero(low < high)
                    if not len(todo):
                        break
                    mid = (low[todo] + high[todo]) >> 1
                    # Equal suffixes keep the left run first.
                    smaller = before(order[mid], item[todo], equal=not is_left)
                    low[todo] = np.where(smaller, mid + 1, low[todo])
                    high[todo] = np.where(smaller, high[todo], mid)
                pieces.append((base + inside + (low - origin), item))
            for to, item in pieces:
                order[to] = item
        width *= 2
    shared = np.full(n, -1, np.int64)
    near = np.flatnonzero(group[1:] == group[:-1]) + 1
    a, b = order[near - 1], order[near]
    room = np.minimum(stop[a] - start[a], stop[b] - start[b])
    shared[near] = _verified(data, start[a], start[b], _extent(hashes, start[a], start[b], room))
    return order, shared


def _verified(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The lengths, cut where bytes differ although hashes agreed."""
    out = length.copy()
    for block in range(0, len(a), 4096):
        size = length[block : block + 4096]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row = np.repeat(np.arange(len(size)), size)
        wrong = np.flatnonzero(data[np.repeat(a[block : block + 4096], size) + inside] != data[np.repeat(b[block : block + 4096], size) + inside])
        if len(wrong):
            np.minimum.at(out, block + row[wrong], inside[wrong])
    return out


def repeated_windows(group: np.ndarray, context: list[bytes], lead: np.ndarray, near: np.ndarray, far: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance (window start to anchor) of the windows of each place that occur twice in
    its group, -1 where none does. `lead` is the anchor's place in its context, `near` to `far` its windows' distances."""
    n = len(group)
    sizes = np.array([len(c) for c in context])
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(context), np.uint8)
    total = len(data)
    right, shared_right = suffix_sort(data, group, base + lead, base + sizes)
    # Backwards, a context is read from the byte before its anchor down to its first.
    left, shared_left = suffix_sort(data[::-1].copy(), group, total - base - lead, total - base)
    least, most = np.full(n, -1), np.full(n, -1)
    interval_right, interval_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(int(near.min()), int(far.max()) + 1):
        active = np.flatnonzero((near <= d) & (d <= far))
        if len(active) < 2:
            continue
        interval_right[right] = np.cumsum(shared_right < span - d)
        interval_left[left] = np.cumsum(shared_left < d)
        both = interval_left[active] * (n + 1) + interval_right[active]
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        twice = np.zeros(len(active), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        hit = active[twice]
        least[hit] = np.where(least[hit] < 0, d, least[hit])
        most[hit] = d
    return least, most


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _anchored(docs: DataFrame, id_column: str, text_column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stored (id, keep, row, n_bytes, sha256, packed, found): every text with its anchors."""
    columns = F.struct(*[F.col(f"`{k}`") for k in keep]) if keep else F.lit(0)  # apart from what stands beside them
    other = F.struct(columns.alias("columns"), F.col(f"`{text_column}`").isNull().alias("no_text"))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), other.alias("keep"), text_or_empty(text_column).cast("binary").alias("text"))
    fields = {"h": pa.int64(), "p": pa.int64(), "lo": pa.int64(), "hi": pa.int64()}
    schema = f"id {rows.schema['id'].dataType.simpleString()}, keep {rows.schema['keep'].dataType.simpleString()}, n_bytes long, sha256 string, packed binary, found array<struct<h:long,p:long,lo:long,hi:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            data = np.frombuffer(b"".join(texts), np.uint8)
            # A long text is taken in pieces that share all but one byte of a window.
            parts = [anchors(data, ends)] if len(data) <= PIECE else []
            for a in range(0, len(data), PIECE) if not parts else ():
                piece = data[a : a + PIECE + SPAN - 1]
                h, *rest = anchors(piece, np.minimum(ends[ends > a] - a, len(piece)))
                parts.append((h, *[x + a for x in rest]))
            h, p, lo, hi = (np.concatenate(x) for x in zip(*parts))
            owner = np.searchsorted(ends, p, "right")
            shift = (ends - sizes)[owner]
            counts = np.bincount(owner, minlength=len(texts))
            inner = pa.StructArray.from_arrays([pa.array(h.astype(np.int64)), *[pa.array(x - shift) for x in (p, lo, hi)]], names=list(fields))
            found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), inner)
            made = [pa.array(sizes), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([packer.compress(t) for t in texts], pa.binary()), found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("keep"), *made], names=["id", "keep", "n_bytes", "sha256", "packed", "found"])

    return stored(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "suffix-docs")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for the comparison: contexts of places (kind 0), digests of hot windows (1), finished spans (2).

    `known` marks a row that stands for several equal ones, whose spans are among the finished.
    """
    unpack = zstandard.ZstdDecompressor()
    names = ["g", "kind", "row", "p", "lo", "hi", "known", "context"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    met: dict[tuple, list] = {}  # (hash, lead, context): [row, place, first window, last, known, hot]
    spans: dict[int, list[tuple[int, int]]] = {}
    held = 0

    def sent() -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (h, _, context), (row, p, lo, hi, known, hot) in met.items():
            if not hot:
                out.append((h, 0, row, p, lo, hi, known, context))
                continue
            for s in range(lo, hi + 1):
                digest = xxhash.xxh3_128_digest(context[s - lo : s - lo + SPAN])
                out.append((int.from_bytes(digest[:8], "little", signed=True), 1, row, s, s, s, known, digest))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
                out = []
        out += [(row, 2, row, 0, a, b, True, None) for row, found in spans.items() for a, b in _merged(found)]
        for start in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out[start : start + 20_000]), kinds)], names=names)
        met.clear()
        spans.clear()

    for batch in slices(batches, "packed", 1 << 20):
        for row, packed, found in zip(*(batch.column(x).to_pylist() for x in ("row", "packed", "found"))):
            text = unpack.decompress(packed)
            for x in found:
                p, lo, hi = x["p"], x["lo"], x["hi"]
                key = (x["h"], p - lo, text[lo : hi + SPAN])
                if key in met:
                    spans.setdefault(row, []).append((lo, hi + SPAN))
                    first = met[key]
                    if not first[4]:
                        spans.setdefault(first[0], []).append((first[2], first[3] + SPAN))
                        first[4] = True
                else:
                    met[key] = [row, p, lo, hi, False, x["hot"]]
                    held += hi + SPAN - lo
            if held > 4 << 20:
                yield from sent()
                held = 0
    yield from sent()


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int = 2_000) -> Iterator[pa.Table]:
    """Tables of whole groups of `g`, of `most` rows or else one group."""
    for rows in _groups(batches, "g", most):
        g = rows.column("g").to_numpy()
        heads = np.append(np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g))
        start = 0
        while start < len(heads) - 1:
            stop = max(start + 1, int(np.searchsorted(heads, heads[start] + most, "right")) - 1)
            yield rows.slice(heads[start], heads[stop] - heads[start])
            start = stop


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (row, a, b) from rows sorted by (kind, g, context)."""
    for rows in _whole_groups(batches):
        kind = rows.column("kind").to_numpy()
        g, row, p, lo, hi = (rows.column(x).to_numpy() for x in ("g", "row", "p", "lo", "hi"))
        known = rows.column("known").to_numpy()
        made = [(row[kind == 2], lo[kind == 2], hi[kind == 2])]
        hot = np.flatnonzero(kind == 1)
        if len(hot):
            digest = rows.column("context").take(pa.array(hot)).to_pylist()
            count: dict[bytes, int] = {}
            for x in digest:
                count[x] = count.get(x, 0) + 1
            at = hot[np.array([count[x] > 1 for x in digest]) & ~known[hot]]
            made.append((row[at], lo[at], lo[at] + SPAN))
        at = np.flatnonzero(kind == 0)
        # Rows of other kinds stand between: groups of places are brought together again.
        at = at[np.argsort(g[at], kind="stable")]
        if len(at):
            sizes = np.unique(g[at], return_counts=True)[1]
            at = at[np.repeat(sizes, sizes) > 1]
        if len(at):
            context = rows.column("context").take(pa.array(at)).to_pylist()
            least, most = repeated_windows(g[at], context, (p - lo)[at], (p - hi)[at], (p - lo)[at])
            good = (least >= 0) & ~known[at]
            made.append((row[at][good], (p[at] - most)[good], (p[at] - least)[good] + SPAN))
        row, a, b = (np.concatenate(x) for x in zip(*made))
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(a), pa.array(b)], names=["row", "a", "b"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """Stored (row, spans): what each text of an `_anchored` table shares with another place, as merged ranges of bytes."""
    each = texts.select("row", F.explode("found").alias("x")).select("row", "x.*")
    # Stored, so that the join below is between two plain exchanges and Spark can split a hash that very many places share.
    twice = stored(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-twice")
    mine = each.join(twice, "h").select("row", F.struct("h", "p", "lo", "hi", (F.col("n") > HOT).alias("hot")).alias("x"))
    found = mine.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("found"))
    met = texts.select("row", "packed").join(found, "row")
    fields = "g long, kind int, row long, p long, lo long, hi long, known boolean, context binary"
    dealt = met.mapInArrow(_contexts, fields).repartition("g").sortWithinPartitions("g", "kind")
    spans = dealt.mapInArrow(_compare, "row long, a long, b long")
    return stored(spans.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "suffix-spans")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = (), text: bool = True) -> DataFrame:
    """One row per row of docs: id, the columns in `keep`, n_bytes, n_removed, n_spans, spans, kept_sha256 and, if
    asked for, the bytes kept (null where the text is)."""
    texts = _anchored(docs, id_column, text_column, keep)
    rows = texts.select("id", "keep", "n_bytes", "sha256", "packed", "row").join(repeated_spans(texts), "row", "left")
    kind, kept = (texts.schema[x].dataType.simpleString() for x in ("id", "keep"))
    schema = f"id {kind}, keep {kept}, n_bytes long, n_removed long, n_spans long, spans array<struct<a:long,b:long>>, kept_sha256 string, kept binary"
    names = ["id", "keep", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, "packed", 2 << 20):
            out: list[tuple] = []
            for packed, whole, found in zip(*(batch.column(x).to_pylist() for x in ("packed", "sha256", "spans"))):
                merged = _merged([(s["a"], s["b"]) for s in found or []])
                rest = None
                if merged or text:
                    raw = unpack.decompress(packed)
                    cuts = [0, *[x for s in merged for x in s], len(raw)]
                    rest = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                    whole = hashlib.sha256(rest).hexdigest() if merged else whole
                out.append((sum(b - a for a, b in merged), len(merged), [{"a": a, "b": b} for a, b in merged], whole, rest if text else None))
            made = [pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names[:3]], *made], names=names)

    made = rows.select("id", "keep", "n_bytes", "sha256", "packed", "spans").mapInArrow(run, schema)
    bytes_kept = [F.when(~F.col("keep")["no_text"], F.col("kept")).alias("kept")] if text else []
    return made.select(F.col("id").alias(id_column), *[F.col("keep")["columns"][c].alias(c) for c in keep], *names[2:-1], *bytes_kept)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs with their repeated strings removed; half characters at a cut go too."""
    keep = tuple(c for c in docs.columns if c not in (id_column, text_column))
    texts = _anchored(docs, id_column, text_column, keep)
    rows = texts.select("id", "keep", "packed", "row").join(repeated_spans(texts), "row", "left").select("id", "keep", "packed", "spans")
    kind, kept = (texts.schema[x].dataType.simpleString() for x in ("id", "keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, "packed", 2 << 20):
            out = []
            for packed, found in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist()):
                raw = unpack.decompress(packed)
                cuts = [0, *[x for s in _merged([(s["a"], s["b"]) for s in found or []]) for x in s], len(raw)]
                out.append("".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip(cuts[::2], cuts[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("keep"), pa.array(out, pa.string())], names=["id", "keep", "text"])

    made = rows.mapInArrow(run, f"id {kind}, keep {kept}, text string")
    text = F.when(~F.col("keep")["no_text"], F.col("text"))
    column = {id_column: F.col("id"), text_column: text}
    return made.select(*[column.get(c, F.col("keep")["columns"][c] if c in keep else None).alias(c) for c in docs.columns])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps after its repeated strings of 400 bytes are removed."""
    return remove_repeats(table(spark, sf_dir, "documents"), text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
