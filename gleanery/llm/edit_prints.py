"""Document fingerprints by randomised edit embedding.

A random walk reads a text: at step j it emits the character under its pointer, and a shared random function of
(j, character) decides whether the pointer moves on. Texts that differ by few edits soon walk in step again, so edit
distance turns into Hamming distance between the emitted strings. A long text is walked in lanes:
it is cut after characters whose last eight hash to a mark, and a lane's random functions are seeded by those
eight characters, so an edit disturbs its own lane only. Every emitted character of the whole text adds
+1 or -1, by a hash of lane seed, step and character, to one of 256 sums; the signs are the fingerprint.
The share of differing bits is the angle between two texts, and its cosine their likeness.

`search_prints` finds likely neighbours: bits sampled into bands, an equi-join on (band, bits), and
the whole fingerprints of the candidates compared. Equal fingerprints are one class there. The bands follow from the
likeness sought, so that 95 of 100 pairs just at it are found. `search_texts` confirms such pairs by the edit
distance of their texts. Neither is part of `op7_edit_fingerprints`.

Defined cases: a null text is an empty one; an empty text has the fingerprint of 64 zeros, is like other
empty texts (1) and unlike the rest. Sums that are 0 take the bit of the next sum that is not, so short texts
are compared by what they have. Equal texts have equal fingerprints. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm.common import mix64, partitions, random_words, slices, stored, table, text_or_empty

BITS = 256
#: Characters that make a mark, mean and greatest length of a lane, and lanes walked together.
GRAM, MEAN_LANE, MAX_LANE, TOGETHER = 8, 128, 1024, 1 << 14
#: Most bits sampled into a band of a search, and most bands of one.
SAMPLED, BANDS = 16, 128
_STEPS = 512
_WALK = random_words(1, _STEPS * 256).reshape(_STEPS, 256)
_GRAM = random_words(2, 256 * GRAM).reshape(GRAM, 256)
_TURN = random_words(3, 64)
_FILL = (random_words(4, BITS) & np.uint64(1)).astype(bool)


def _lanes(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length, seed and text number of every lane of the texts that end at `ends`."""
    heads = np.concatenate([[0], ends[:-1]])
    full = np.zeros(len(codes), np.uint64)
    for k in range(GRAM):
        full[k:] += _GRAM[k][codes[: max(0, len(codes) - k)]]
    full = mix64(full)
    mark = (full % np.uint64(MEAN_LANE)) == 0
    for k in range(GRAM - 1):  # the first characters of a text have no gram of their own
        at = heads + k
        mark[at[at < ends]] = False
    cut = np.flatnonzero(mark) + 1
    owner = np.searchsorted(ends, cut, "right")
    inner = cut < ends[np.minimum(owner, len(ends) - 1)]
    inner &= ~np.isin(cut, heads)
    cut = cut[inner]
    starts = np.concatenate([heads[heads < ends], cut])
    seeds = np.concatenate([np.full((heads < ends).sum(), 77, np.uint64), full[cut - 1]])
    order = np.argsort(starts, kind="stable")
    starts, seeds = starts[order], seeds[order]
    owner = np.searchsorted(ends, starts, "right")
    stops = np.minimum(np.append(starts[1:], len(codes)), ends[owner])
    pieces = -(-(stops - starts) // MAX_LANE)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts, owner = np.repeat(starts, pieces) + nth * MAX_LANE, np.repeat(owner, pieces)
    sizes = np.minimum(MAX_LANE, np.repeat(stops, pieces) - starts)
    seeds = mix64(np.repeat(seeds, pieces) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return starts, sizes, seeds, owner


def fingerprints(texts: list[str]) -> np.ndarray:
    """Fingerprints of texts as rows of 32 bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
    ends = np.cumsum(sizes)
    sums = np.zeros(len(texts) * BITS * 2, np.int64)
    if len(codes):
        starts, lengths, seeds, owners = _lanes(codes, ends)
        order = np.argsort(-lengths, kind="stable")
        for block in range(0, len(order), TOGETHER):
            at = order[block : block + TOGETHER]
            place, stop, seed, base = starts[at].copy(), (starts + lengths)[at], seeds[at], owners[at] * (BITS * 2)
            step, found, held = 0, [], 0
            while len(place):
                if step % 32 == 0 and step:
                    alive = place < stop
                    place, stop, seed, base = place[alive], stop[alive], seed[alive], base[alive]
                    if not len(place):
                        break
                # Lanes that have ended meanwhile emit nothing: their place is moved to a neutral one.
                on = place < stop
                char = codes[np.minimum(place, len(codes) - 1)]
                draw = (_WALK[step % _STEPS][char] ^ seed) * np.uint64(0x9E3779B97F4A7C15) + _TURN[step // _STEPS % 64]
                draw ^= draw >> np.uint64(29)
                slot = base + (draw >> np.uint64(40) & np.uint64(BITS * 2 - 1)).astype(np.int64)
                found.append(slot[on] if step % 32 else slot)
                held += len(slot)
                place = place + (draw & np.uint64(1)).astype(np.int64)
                step += 1
                if held > 2_000_000:
                    sums += np.bincount(np.concatenate(found), minlength=len(sums))
                    found, held = [], 0
            if found:
                sums += np.bincount(np.concatenate(found), minlength=len(sums))
    pairs = sums.reshape(len(texts), BITS, 2)
    value = pairs[:, :, 0] - pairs[:, :, 1]
    bits = value > 0
    holes = (value == 0) & (sizes > 0)[:, None]
    if holes.any():
        rows = np.flatnonzero(holes.any(1) & (value != 0).any(1))
        lack, known = value[rows] == 0, bits[rows]
        twice = np.concatenate([lack, lack], 1)
        # The next sum (cyclically) that is not 0, for every sum.
        where = np.where(twice, 1 << 30, np.arange(2 * BITS)[None])
        nearest = np.minimum.accumulate(where[:, ::-1], 1)[:, ::-1][:, :BITS] % BITS
        borrowed = np.take_along_axis(known, nearest, 1) ^ _FILL[None]
        bits[rows] = np.where(lack, borrowed, known)
    return np.packbits(bits, 1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the angle that the differing bits of two fingerprints stand for, 0 at least."""
    apart = np.unpackbits(a ^ b, axis=1).sum(1) / BITS
    same_kind = a.any(1) == b.any(1)
    return np.where(same_kind, np.maximum(0.0, np.cos(np.pi * apart)), 0.0)


def fingerprint_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            made = [x.tobytes().hex() for x in fingerprints(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made)], names=["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_column)


def banding(least: float, recall: float = 0.95) -> tuple[int, int]:
    """Bands and bits sampled in each that find a pair of likeness `least` with a probability of `recall` or more.

    The most bits, `SAMPLED` at most, for which `BANDS` bands suffice; a likeness that every pair has takes none, so that all meet.
    """
    apart = max(d for d in range(BITS + 1) if d == 0 or max(0.0, math.cos(math.pi * d / BITS)) >= least)
    for sampled in range(SAMPLED, 0, -1):
        hit = math.comb(BITS - apart, sampled) / math.comb(BITS, sampled)  # no sampled bit differs
        bands = 1 if hit == 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit else BANDS + 1
        if bands <= BANDS:
            return bands, sampled
    return 1, 0


def search_prints(prints: DataFrame, queries: DataFrame, least: float = 0.8, bands: int | None = None, sampled: int | None = None, recall: float = 0.95) -> DataFrame:
    """(query, fingerprint, likeness): fingerprints at least `least` like those of queries, one row for each pair of classes.

    Both tables have a column `fingerprint` in hexadecimal. Members of a class are found by an equi-join
    on the fingerprint; copies are never expanded here. Bands and sampled bits follow from `least` and `recall`, the share of
    pairs just at `least` that are found (of more similar ones more are); both may be given instead.
    """
    if (bands is None) != (sampled is None):
        raise ValueError("bands and sampled are given together or not at all")
    if bands is None:
        bands, sampled = banding(least, recall)
    rng = np.random.default_rng(5)
    chosen = [np.sort(rng.choice(BITS, sampled, replace=False)) for _ in range(bands)]
    places = 1 << np.arange(sampled, dtype=np.int64)

    def banded(df: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    part = batch.column(0).slice(start, 1000)
                    bits = np.unpackbits(np.frombuffer(bytes.fromhex("".join(part.to_pylist())), np.uint8).reshape(len(part), -1), axis=1)
                    keys = [bits[:, at].astype(np.int64) @ places for at in chosen]
                    at = np.tile(np.arange(len(part)), bands)
                    band = np.repeat(np.arange(bands, dtype=np.int32), len(part))
                    yield pa.RecordBatch.from_arrays([part.take(pa.array(at)), pa.array(band), pa.array(np.concatenate(keys))], names=[name, "band", "key"])

        return df.select("fingerprint").where("fingerprint IS NOT NULL").distinct().mapInArrow(run, f"{name} string, band int, key long")

    pairs = banded(queries, "query").join(banded(prints, "fingerprint"), ["band", "key"]).select("query", "fingerprint").distinct()
    words = lambda c, k: F.conv(F.substring(c, 1 + 15 * k, 15 if k < 4 else 4), 16, 10).cast("long")
    apart = sum((F.bit_count(words("query", k).bitwiseXOR(words("fingerprint", k))) for k in range(5)), F.lit(0))
    none = F.lit("0" * (BITS // 4))
    same_kind = (F.col("query") == none) == (F.col("fingerprint") == none)
    alike = F.when(same_kind, F.greatest(F.lit(0.0), F.cos(F.pi() * apart / BITS))).otherwise(0.0)
    return pairs.withColumn("likeness", alike).where(F.col("likeness") >= least)


def search_texts(docs: DataFrame, queries: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = 0.8, most_edits: float = 0.2, recall: float = 0.95) -> DataFrame:
    """(query_id, id, likeness, edits): pairs of texts found by their fingerprints and confirmed by their edit distance.

    `edits` is the number of characters to insert, delete or replace, at most `most_edits` of the longer text. Equal
    texts are one class on either side, named by its smallest id; a null text is an empty one.
    """

    def classes(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(text_column).alias("text"))
        one = rows.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("same")).agg(F.min("id").alias("id"), F.first("text").alias("text"))
        made = fingerprint_texts(one.select(F.struct("id", "text").alias("of"), "text"), "of", "text")
        return stored(made.select(F.col("of.id").alias("id"), F.col("of.text").alias("text"), "fingerprint"), f"edit-{name}")

    mine, asked = classes(docs, "texts"), classes(queries, "queries")
    pairs = search_prints(mine, asked, least, recall=recall)
    asked = asked.select(F.col("id").alias("query_id"), F.col("text").alias("query_text"), F.col("fingerprint").alias("query"))
    both = pairs.join(asked, "query").join(mine, "fingerprint")
    longer, shorter = F.greatest(F.length("text"), F.length("query_text")), F.least(F.length("text"), F.length("query_text"))
    both = both.withColumn("most", F.floor(F.lit(most_edits) * longer).cast("int")).where(longer - shorter <= F.col("most"))
    both = both.withColumn("edits", F.expr("levenshtein(query_text, text, most)")).where("edits >= 0")
    return both.select("query_id", "id", "likeness", "edits")


def _edited(text: str, following: str) -> str:
    share = len(text) // 3
    return text[: len(text) - share] + following[:share]


_FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(ids: pa.Array, texts: list[str], prints: np.ndarray, following: list[str], next_prints: np.ndarray) -> list[pa.Array]:
    edited = [_edited(a, b) for a, b in zip(texts, following)]
    made = fingerprints(edited)
    return [
        ids,
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
        pa.array([x.tobytes().hex() for x in prints], pa.string()),
        pa.array([x.tobytes().hex() for x in made], pa.string()),
        pa.array(likeness(prints, made), pa.float64()),
        pa.array(likeness(prints, next_prints), pa.float64()),
    ]


def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likenesses.

    Documents are dealt by range of id, falling, and sorted, so the next one is nearly always in the same
    partition. The first and the last row of each partition are kept aside with their texts and
    matched afterwards: two rows for each partition.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = docs.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def aside(role: str, ids: pa.Array, text: str) -> pa.RecordBatch:
            empty = [pa.nulls(1, k) for k in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([ids, *empty, pa.array([role]), pa.array([part], pa.int32()), pa.array([text], pa.string())], names=[*_FIELDS, "role", "part", "text"])

        last = None
        for batch in slices(batches, "text", 4 << 20):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            prints = fingerprints(texts)
            if last is None:
                yield aside("first", ids.slice(0, 1), texts[0])
            else:
                ids, texts, prints = pa.concat_arrays([last[0], ids]), [last[1], *texts], np.concatenate([last[2], prints])
            n = len(texts) - 1
            last = ids.slice(n, 1), texts[n], prints[n:]
            if n:
                done = _compared(ids.slice(0, n), texts[:n], prints[:n], texts[1:], prints[1:])
                yield pa.RecordBatch.from_arrays([*done, pa.nulls(n, pa.string()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())], names=[*_FIELDS, "role", "part", "text"])
        if last is not None:
            yield aside("last", last[0], last[1])

    found = stored(dealt.mapInArrow(walk, f"{fields}, role string, part int, text string"), "edit-prints")
    parts = sorted(r.part for r in found.where("role = 'first'").select("part").collect())
    if not parts:
        return found.select(*_FIELDS)
    after = F.create_map(*[F.lit(x) for pair in zip(parts, [*parts[1:], parts[0]]) for x in pair])
    tails = found.where("role = 'last'").select("doc_id", "text", F.element_at(after, F.col("part")).alias("part"))
    heads = found.where("role = 'first'").select("part", F.col("text").alias("following"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = batch.column("text").to_pylist(), batch.column("following").to_pylist()
            if texts:
                yield pa.RecordBatch.from_arrays(_compared(batch.column("doc_id"), texts, fingerprints(texts), following, fingerprints(following)), names=_FIELDS)

    edges = tails.join(heads, "part").select("doc_id", "text", "following").mapInArrow(join, fields)
    return found.where("role IS NULL").select(*_FIELDS).union(edges)
