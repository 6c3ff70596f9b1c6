"""Best-fit packing by hierarchical residual packing.

Items are dealt to partitions of about `ITEMS` rows. Each partition packs its own items best-fit, longest
first, into bins. Bins that nothing left could fill (residual under the shortest item, or a few
tokens) are final; the underfull ones become items of the next round, which has as many fewer partitions as it has
fewer items. Every other round deals items by how far they are from half a sequence, so that fills which complete each
other meet. Rounds end when one partition holds all, or when neither way of dealing merges anything. A task holds one partition's items and nothing grows with the whole; every round is a stored table.

A document is cut only if it is longer than a sequence: into whole sequences, the first piece being the rest.

Defined cases: a null text is an empty one, with the end id alone. Repeated rows and null ids are packed like
any others. Items have lengths from 1 to the capacity; a null length or one outside raises. No items, no bins.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm.common import slices, stored, table, text_or_empty
from gleanery.llm.tokens import encoder, vocabulary

CAPACITY = 2048
#: Items a task packs, about; tokens a final bin may lack.
ITEMS, SLACK = 20_000, 8


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes where the least room stays."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual
    open_ = 0  # bit r: some bin has residual r
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fits = open_ >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                open_ &= ~(1 << left)
            bins[at].append(item)
            left -= need
        else:
            at, left = len(bins), capacity - need
            bins.append([item])
        if left:
            room[left].append(at)
            open_ |= 1 << left
    return bins


def _merge(rows: pa.Table, capacity: int, least: int) -> pa.RecordBatch:
    """Pack one partition's rows (fill, members) into rows (fill, members, final)."""
    fill = rows.column("fill").to_numpy()
    members = pa.concat_arrays(rows.column("members").chunks)
    bins = best_fit(fill, capacity)
    order = np.concatenate([np.array(b, np.int64) for b in bins])
    sizes = np.array([len(b) for b in bins])
    starts = np.cumsum(sizes) - sizes
    taken = members.take(pa.array(order))
    counts = np.add.reduceat(taken.value_lengths().to_numpy(zero_copy_only=False), starts)
    inner = taken.flatten()
    fields = {inner.type.field(i).name: inner.field(i) for i in range(inner.type.num_fields)}
    length = fields["length"].to_numpy(zero_copy_only=False)
    places = np.cumsum(length) - length
    heads = np.cumsum(counts) - counts
    fields["offset"] = pa.array(places - np.repeat(places[heads], counts), pa.int64())
    out = pa.ListArray.from_arrays(pa.array(np.append(heads, counts.sum()), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))
    full = np.add.reduceat(fill[order], starts)
    final = capacity - full < max(least, SLACK)
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), out, pa.array(final)], names=["fill", "members", "final"])


def pack(items: DataFrame, length_column: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Every row of items with sequence_id and offset, its place in a sequence of at most `capacity`."""
    length = F.col(f"`{length_column}`").cast("long")
    length = F.when(length.between(1, capacity), length).otherwise(F.raise_error(F.lit("an item's length must be from 1 to the capacity")).cast("long"))
    member = F.struct(length.alias("length"), F.lit(0).cast("long").alias("offset"), F.struct("*").alias("item"))
    waiting = stored(items.select(length.alias("fill"), F.array(member).alias("members")), "pack-items")
    schema = f"fill long, members {waiting.schema['members'].dataType.simpleString()}, final boolean"
    whole = [waiting.where(F.col("fill") == capacity)]
    waiting, turn, idle = waiting.where(F.col("fill") < capacity), 0, 0
    while True:
        count, least = waiting.agg(F.count(F.lit(1)), F.min("fill")).first()
        if not count:
            break
        parts = math.ceil(count / ITEMS)

        def run(batches: Iterator[pa.RecordBatch], least: int = least) -> Iterator[pa.RecordBatch]:
            rows = [b for b in batches if b.num_rows]
            if rows:
                merged = _merge(pa.Table.from_batches(rows), capacity, least)
                for start in range(0, merged.num_rows, 5_000):
                    yield merged.slice(start, 5_000)

        # The seeded random number only spreads equal fills over partitions.
        dealt = waiting.repartition(parts) if turn % 2 == 0 else waiting.repartitionByRange(parts, F.abs(F.col("fill") * 2 - capacity), F.rand(turn))
        packed = stored(dealt.mapInArrow(run, schema), f"pack-{turn}")
        bins, open_ = packed.agg(F.count(F.lit(1)), F.count(F.when(~F.col("final"), 1))).first()
        idle = idle + 1 if bins == count else 0
        last = parts == 1 or open_ == 0 or idle == 2
        whole.append(packed if last else packed.where("final"))
        if last:
            break
        waiting, turn = packed.where(~F.col("final")), turn + 1
    out = None
    for k, bins in enumerate(whole):
        numbered = bins.select((F.lit(k << 57) + F.monotonically_increasing_id()).alias("sequence_id"), "members").select("sequence_id", F.explode("members").alias("m"))
        out = numbered if out is None else out.union(numbered)
    return out.select("m.item.*", "sequence_id", F.col("m.offset").alias("offset"))


def token_pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary_name: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32 and, if asked for, ids) of every piece of every document."""
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary(vocabulary_name))
        for batch in slices(batches, "text", keeps="pieces"):
            out: list[tuple] = []
            for at, made in enumerate(tool.encode(batch.column("text").to_pylist())):
                made += end
                n = len(made) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    body = made[4 * a : 4 * b]
                    out.append((at, piece, a, b - a, zlib.crc32(body), np.frombuffer(body, "<i4") if ids else None))
            at, piece, start, length, crc, body = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)], pa.array(body, pa.list_(pa.int32()))],
                names=["id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    made = rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>").withColumnRenamed("id", id_column)
    return made if ids else made.drop("ids")


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(token_pieces(table(spark, sf_dir, "documents"), ids=False))
