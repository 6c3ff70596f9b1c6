"""Running values over ordered rows of a key that may hold a third of the table.

A plain window over such a key is one task. Here rows are dealt by range of (key, order), so every
partition holds about as many rows as any other and a hot key lies in many. A partition's rows of one key
are a cell: rows meet only within their cell, one small summary row per cell carries the value from
cell to cell, and both parts combine. This works for any associative running value. The table is read and
dealt once; what is dealt is checkpointed, and everything after works on that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gleanery.session import cut_lineage

CELL = "__cell"


def deal(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df in cells: contiguous stretches of a key, numbered in order."""
    dealt = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    return dealt.withColumn(CELL, F.spark_partition_id())


def in_cell(keys: Sequence[str], order: Sequence[str], first: int = W.unboundedPreceding, last: int = 0):  # noqa: ANN201
    return W.partitionBy(CELL, *keys).orderBy(*order).rowsBetween(first, last)


def cells_before(keys: Sequence[str]):  # noqa: ANN201
    return W.partitionBy(*keys).orderBy(CELL).rowsBetween(W.unboundedPreceding, -1)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, tuple[str, Column]],
    before: bool = False,
) -> DataFrame:
    """Add running 'sum' or 'max' columns: values maps a new name to (kind, column).

    With before=True the current row is left out (what was known when it arrived).
    """
    fold = {"sum": F.sum, "max": F.max}
    here = in_cell(keys, order, last=-1 if before else 0)
    rows = deal(df, keys, order).withColumns({f"__in_{name}": column for name, (_, column) in values.items()})
    rows = cut_lineage(rows.withColumns({f"__run_{name}": fold[kind](f"__in_{name}").over(here) for name, (kind, _) in values.items()}))
    summary = rows.groupBy(CELL, *keys).agg(*[fold[kind](f"__in_{name}").alias(f"__sum_{name}") for name, (kind, _) in values.items()])
    earlier = cells_before(keys)
    carried = summary.select(CELL, *keys, *[fold[kind](f"__sum_{name}").over(earlier).alias(f"__carry_{name}") for name, (kind, _) in values.items()])

    def both(name: str, kind: str) -> Column:
        run, carry = F.col(f"__run_{name}"), F.col(f"__carry_{name}")
        return F.coalesce(run, F.lit(0)) + F.coalesce(carry, F.lit(0)) if kind == "sum" else F.greatest(run, carry)

    out = rows.join(carried, [CELL, *keys])
    return out.select(*df.columns, *[both(name, kind).alias(name) for name, (kind, _) in values.items()])


def next_at(df: DataFrame, keys: Sequence[str], order: Sequence[str], reach: Column, ident: Column) -> DataFrame:
    """(ident, next): for every row the first row of its key that stands at or after its `reach`.

    Rows and what they ask for are dealt as one table, so a row finds its next one in its own cell or
    in the first later cell that holds rows.
    """
    rows = df.select(*keys, F.col(order[0]).alias("__at"), F.lit(1).alias("__kind"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order[1:])], ident.alias("__id"))
    # A question stands before all rows of its moment, but behind its own row if that reaches no further.
    own = reach <= F.col(order[0])
    asked = df.select(*keys, F.greatest(reach, F.col(order[0])).alias("__at"), F.when(own, 2).otherwise(0).alias("__kind"), *[F.when(own, F.col(c)).alias(f"__o{i}") for i, c in enumerate(order[1:])], ident.alias("__id"))
    by = ["__at", *[f"__o{i}" for i in range(len(order) - 1)], "__kind"]
    dealt = deal(rows.unionByName(asked), keys, by)
    row_id = F.when(F.col("__kind") == 1, F.col("__id"))
    behind = in_cell(keys, by, 1, W.unboundedFollowing)
    found = cut_lineage(dealt.withColumn("__next", F.first(row_id, ignorenulls=True).over(behind)))
    heads = found.where("__kind = 1").groupBy(CELL, *keys).agg(F.min_by("__id", F.struct(*by)).alias("__head"))
    cells = found.select(CELL, *keys).distinct().join(heads, [CELL, *keys], "left")
    later = W.partitionBy(*keys).orderBy(CELL).rowsBetween(1, W.unboundedFollowing)
    cells = cells.select(CELL, *keys, F.first("__head", ignorenulls=True).over(later).alias("__later"))
    return found.where("__kind != 1").join(cells, [CELL, *keys]).select(F.col("__id").alias("ident"), F.coalesce("__next", "__later").alias("next"))


def chain(df: DataFrame, keys: Sequence[str], order: Sequence[str], reach: Column, ident: str) -> DataFrame:
    """(ident): the rows met by going, from the first row of each key, always to the first one at or after the reach.

    A row that stands at or after the reach of all rows before it is met whatever came before: it is a
    start. From the starts the met rows double in every round, as steps of 1, 2, 4, ... rows are composed, so a
    key that is never idle takes the logarithm of its length in rounds, each spread over all its rows.
    """
    seen = running(df.withColumn("__reach", reach), keys, order, {"__before": ("max", F.col("__reach"))}, before=True)
    start = F.col("__before").isNull() | (F.col(order[0]) >= F.col("__before"))
    flagged = cut_lineage(seen.select(ident, start.alias("start")))
    met = flagged.where("start").select(ident)
    if flagged.where("NOT start").isEmpty():
        return met
    step = next_at(df, keys, order, reach, F.col(ident)).where("next IS NOT NULL")
    # A start is met without being stepped to.
    starts = flagged.where("start").select(F.col(ident).alias("next"))
    step = cut_lineage(step.join(starts, "next", "left_anti"))
    met, many = cut_lineage(met), -1
    while True:
        further = met.join(step, F.col(ident) == F.col("ident")).select(F.col("next").alias(ident))
        met = cut_lineage(met.union(further).distinct())
        count = met.count()
        if count == many:
            return met
        many = count
        a, b = step.alias("a"), step.alias("b")
        step = cut_lineage(a.join(b, F.col("a.next") == F.col("b.ident")).select("a.ident", "b.next"))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], reach: Column, out: str = "island") -> DataFrame:
    """Number the stretches of each key between which state cannot carry over.

    `reach` is the latest moment up to which a row can still influence later ones; a row
    at or after every earlier reach starts a new island.
    """
    seen = running(df, keys, order, {"__reach": ("max", reach)}, before=True)
    starts = F.when(F.col("__reach").isNull() | (F.col(order[0]) >= F.col("__reach")), 1).otherwise(0)
    flagged = seen.withColumn("__start", starts).drop("__reach")
    return running(flagged, keys, order, {out: ("sum", F.col("__start"))}).drop("__start")


def scan_islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], step, initial, added: str, island: str = "island"
) -> DataFrame:
    """Fold `step(state, row) -> (state, values)` over each island in order.

    Islands are independent, so they spread over the cluster by (key, island). Rows stream
    through in Arrow batches with one small state; no island is ever held in memory.
    """
    schema = T.StructType(df.schema.fields + T._parse_datatype_string(added).fields)
    names = [f.name for f in T._parse_datatype_string(added).fields]
    group = [*keys, island]
    ordered = df.repartition(*group).sortWithinPartitions(*group, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current = None, None
        for pdf in batches:
            results = []
            for row in pdf.itertuples(index=False):
                here = tuple(getattr(row, c) for c in group)
                if here != current:
                    state, current = initial(), here
                state, values = step(state, row)
                results.append(values)
            yield pd.concat(
                [pdf.reset_index(drop=True), pd.DataFrame(results, columns=names).reset_index(drop=True)], axis=1
            )

    return ordered.mapInPandas(run, schema)
