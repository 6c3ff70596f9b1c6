"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: its share of the whole by weight, at most `most` times its own
words; what a capped source cannot take is shared among the others by weight until none is above its cap.
A document's expected copies are target / words of its source. The whole part is given to every document of
the source for certain; the fraction is its inclusion probability p for one more copy. Documents are ranked
by random odds u / (1 - u) over inclusion odds p / (1 - p), the inclusion odds multiplied by an optional
weight of the document, and taken in that order up to the words still missing: a sample of fixed size
with unequal probabilities. A document that is longer than what is missing has no odds; more rounds
down the ranking fill the gap that the last long document left, until no document left out fits its source's gap.
Each round takes at least one document of every source that has a fitting one, mostly many.

Sums run over cells of the ranking: one sum for each (source, cell), and rows are only ordered inside the one cell in
which a source's target falls. So a source with a third of all documents is many cells, and nothing
but a row for each source and cell is brought together. Random numbers are hashes of id and size, hence reruns agree.

Defined cases: a null source is a source, ordered last. A null or empty text has no words and is never
taken. Rows with equal id and size share their random number and are told apart by their order in the
table. An empty table, or one without words, has no targets above 0. Weights are positive; null counts as 1.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gleanery.llm.common import numbered, stored, table, text_or_empty

#: Rows in a cell of the ranking, about; times that a document or source is repeated at most.
CELL_ROWS, MOST = 20_000, 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights by turns to sources in code point order, null last."""
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    turn = numbered(sources.select("source"), order, "turn", "mix-order")
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.col("turn") % len(cycle) + 1).cast("int"))
    return turn.select("source", weight.alias("weight"))


def source_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """(source, total, n, weight) with the target words of each source."""
    total = sources.agg(F.sum("total")).first()[0] or 0
    level = -1.0
    while total:
        # Sources whose cap lies under the current level are full; the rest share what is left by weight.
        full = F.col("total") * most < F.col("weight") * level
        row = sources.agg(F.sum(F.when(full, F.col("total") * most)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        rest = total - (row.full or 0)
        if not row.weight or rest / row.weight <= level:
            break
        level = rest / row.weight
    return sources.withColumn("target", F.least(F.col("total") * float(most), F.col("weight") * max(level, 0.0)))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights=cyclic_weights, odds: str | None = None, keep: tuple[str, ...] = (), most: int = MOST) -> DataFrame:  # noqa: ANN001
    """One row per row of docs: the columns in `keep`, then size, source_size, target and copies.

    `weights` makes a table (source, weight) from one of the sources; `odds` names a column with the
    documents' own weights in the ranking.
    """
    c = lambda name: F.col(f"`{name}`")
    random = (F.shiftrightunsigned(F.xxhash64(F.lit(29), "id", "size"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = docs.select(
        F.struct(*[c(k) for k in keep], F.lit(0).alias("_")).alias("keep"),
        c(id_column).alias("id"),
        c(source_column).cast("string").alias("source"),
        word_count(text_or_empty(text_column)).alias("size"),
        (F.coalesce(c(odds).cast("double"), F.lit(1.0)) if odds else F.lit(1.0)).alias("odds"),
        F.monotonically_increasing_id().alias("row"),
    )
    # The texts are read once; all that follows works on these narrow rows.
    rows = stored(rows.withColumn("u", random), "mix-rows")
    totals = stored(rows.groupBy("source").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")), "mix-sources")
    weighed = totals.alias("t").join(weights(totals).alias("w"), F.col("t.source").eqNullSafe(F.col("w.source"))).select("t.*", F.col("w.weight"))
    rate = F.coalesce(F.col("target") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    plan = (
        source_targets(stored(weighed, "mix-weights"), most)
        .withColumn("whole", F.floor(rate).cast("long"))
        .withColumn("gap", F.col("target") - F.col("whole") * F.col("total"))
        .withColumn("p", F.greatest(rate - F.col("whole"), F.lit(1e-12)))
        .withColumn("cells", F.greatest(F.lit(1), F.ceil(F.col("n") / CELL_ROWS)))
        .withColumn("rounds", F.expr("CAST(array() AS array<struct<gap:double,cut:struct<cell:long,rank:double,row:long>>>)"))
    )
    plan = stored(plan.select(F.col("source").alias("s"), *[x for x in plan.columns if x != "source"]), "mix-plan")
    key = F.struct("cell", "rank", "row")
    taken = F.exists("rounds", lambda r: (F.col("size") <= r.gap) & (key <= r.cut))

    def ranked(plan: DataFrame) -> DataFrame:
        odds_of = F.col("p") / (1 - F.col("p")) * F.col("odds")
        rank = F.col("u") / (1 - F.col("u")) / odds_of
        out = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("rank", rank / (1 + rank))
        return out.withColumn("cell", F.least(F.floor(F.col("rank") * F.col("cells")), F.col("cells") - 1).cast("long"))

    for turn in count():
        fits = ranked(plan).where((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & ~taken)
        sums = fits.groupBy("s", "cell").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
        sums = stored(sums, f"mix-sums-{turn}")
        if sums.isEmpty():
            break
        until = F.sum("words").over(Window.partitionBy("s").orderBy("cell"))
        sums = sums.withColumn("until", until)
        # A source's target falls into its first cell whose running sum exceeds the gap.
        edge = sums.where((F.col("until") > F.col("gap")) & (F.col("until") - F.col("words") <= F.col("gap")))
        edge = edge.select(F.col("s").alias("es"), F.col("cell").alias("ecell"), (F.col("until") - F.col("words")).alias("before"))
        inside = fits.join(edge, F.col("s").eqNullSafe(F.col("es")) & (F.col("cell") == F.col("ecell")))
        run = F.col("before") + F.sum("size").over(Window.partitionBy("es", "ecell").orderBy("rank", "row").rowsBetween(Window.unboundedPreceding, 0))
        inside = inside.withColumn("run", run)
        within = F.col("run") <= F.col("gap")
        cuts = inside.groupBy("es").agg(
            F.coalesce(F.max(F.when(within, key)), F.struct((F.first("ecell") - 1).alias("cell"), F.lit(2.0).alias("rank"), F.lit(0).cast("long").alias("row"))).alias("cut"),
            F.coalesce(F.max(F.when(within, F.col("run"))), F.first("before")).alias("got"),
        )
        # Without such a cell everything that fits is taken.
        whole = sums.groupBy("s").agg(F.max("until").alias("all")).withColumnRenamed("s", "ws")
        everything = F.struct(F.lit(1 << 62).cast("long").alias("cell"), F.lit(2.0).alias("rank"), F.lit(0).cast("long").alias("row"))
        step = plan.join(cuts, F.col("s").eqNullSafe(F.col("es")), "left").join(whole, F.col("s").eqNullSafe(F.col("ws")), "left")
        more = F.when(F.col("all").isNotNull(), F.concat("rounds", F.array(F.struct(F.col("gap"), F.coalesce("cut", everything).alias("cut")))))
        step = step.select(*[x for x in plan.columns if x not in ("gap", "rounds")], F.coalesce(more, "rounds").alias("rounds"), (F.col("gap") - F.coalesce("got", "all", F.lit(0))).alias("gap"))
        plan = stored(step, f"mix-plan-{turn}")
    out = ranked(plan).withColumn("copies", F.col("whole") + (taken & (F.col("size") > 0)).cast("long"))
    return out.select(*[F.col("keep")[k].alias(k) for k in keep], "size", F.col("total").alias("source_size"), "target", "copies")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes, sources weighing 1, 2, 3 by turns."""
    mixed = mix(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
