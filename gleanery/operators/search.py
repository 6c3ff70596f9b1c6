"""Answering searches over the listing table, one at a time or many in one job."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gleanery.session import written

FEED_DEFAULT, FEED_MAX, JSON_MAX = 50, 100, 10_000


@dataclass(frozen=True)
class Query:
    """A normalised search. No trackers means every tracker; no terms match every name."""

    trackers: Sequence[str] = ()
    terms: Sequence[str] = ()
    categories: Sequence[str] = ()
    needs_category: bool = False
    unsearched_terms: Sequence[str] = ()
    ids: Mapping[str, str] = field(default_factory=dict)
    query_key: str = ""
    limit: int = FEED_DEFAULT
    offset: int = 0


def in_trackers(trackers: Sequence[str]) -> Column:
    return F.col("tracker").isin(*trackers) if trackers else F.lit(True)


def name_matches(terms: Sequence[str]) -> Column:
    """Every term is a substring of the name, ignoring case; wildcards are literal."""
    folded = F.lower("name")
    return reduce(lambda p, t: p & F.contains(folded, F.lit(t.lower())), terms, F.lit(True))


def in_categories(categories: Sequence[str]) -> Column:
    """One requested id is among the row's own, or the row is filed under none."""
    if not categories:
        return F.lit(True)
    wanted = F.array(*[F.lit(c) for c in categories])
    return (F.size("categories") == 0) | F.arrays_overlap(F.col("categories").cast("array<string>"), wanted)


def holds_ids(ids: Mapping[str, str]) -> Column:
    """The row holds one of the named ids and contradicts none (leading zeros do not count)."""
    named = {k: v.removeprefix("tt") if k == "imdbid" else v for k, v in ids.items()}
    named = {k: v.lstrip("0") for k, v in named.items() if v}
    if not named:
        return F.lit(True)
    agree = {k: F.ltrim(F.col(k), F.lit("0")) == v for k, v in named.items()}
    holds = reduce(lambda a, b: a | b, [(F.col(k) != "") & same for k, same in agree.items()])
    clean = reduce(lambda a, b: a & b, [(F.col(k) == "") | same for k, same in agree.items()])
    return holds & clean


def where(query: Query) -> Column:
    """All predicates of a search but provenance; cheap, prunable ones come first."""
    predicate = in_trackers(query.trackers) & in_categories(query.categories)
    if query.needs_category:
        predicate = predicate & (F.size("categories") > 0)
    if query.terms:
        predicate = predicate & name_matches(query.terms)
    managed = F.col("search_managed")
    if query.unsearched_terms:
        predicate = predicate & (managed | name_matches(query.unsearched_terms))
    if any(query.ids.values()) and not query.terms:
        predicate = predicate & (managed | holds_ids(query.ids))
    return predicate


def restrict_to_search(listings: DataFrame, bridge: DataFrame, key: str) -> DataFrame:
    """Unmanaged rows, and managed rows this search produced.

    The bridge side is one search's results; only managed rows take part in the join.
    """
    if not key:
        return listings
    produced = bridge.filter(F.col("search_key") == key).select("tracker", "identity")
    managed = listings.filter("search_managed").join(produced, ["tracker", "identity"], "left_semi")
    return listings.filter("NOT search_managed").unionByName(managed)


#: Ordering of a page: column and whether the largest come first. Nulls come last either way.
Order = Sequence[tuple[str, bool]]
NEWEST: Order = (("published", True), ("id", True))
#: Pages that end within so many rows are taken from each task's own top rows; deeper ones are sought by counts.
SHALLOW = 10_000
#: Two to this power cells are counted in one pass.
CELL_BITS = 10


def newest_first(*tie: str) -> list[Column]:
    """Newest release first, unknown dates last, later ids first on ties."""
    return [F.col("published").desc_nulls_last(), *[F.col(c).desc() for c in (tie or ("id",))]]


def by_order(order: Order) -> list[Column]:
    return [F.col(c).desc_nulls_last() if largest else F.col(c).asc_nulls_last() for c, largest in order]


def page(df: DataFrame, limit: int, offset: int, order: Order | Sequence[Column] = NEWEST) -> DataFrame:
    """One page of an ordering; a limit of zero or less is an empty page.

    A page near the start is taken from every task's first rows. A deep one would make one task or the driver hold all
    rows before it, so its place is sought first: rows are counted in about a thousand cells of the order's first field,
    cells wholly before or behind the page drop out, and so on within the cells that hold its ends, and by the next
    field where all rows agree on one. A pass reads the rows and brings back its counts; no row is moved until
    few enough are left to sort. The order should be total and names columns; sort expressions are sorted as they are.
    """
    limit, offset = max(limit, 0), max(offset, 0)
    if order and not isinstance(order[0], tuple):
        return df.orderBy(*order).offset(offset).limit(limit)
    if limit and offset + limit > SHALLOW:
        rows = df.count()
        if offset >= rows:
            return df.limit(0)
        parts, before = _near(df, offset, min(offset + limit, rows), rows, _fields(df, order))
        df, offset = reduce(DataFrame.unionByName, parts), offset - before
    return df.orderBy(*by_order(order)).offset(offset).limit(limit)


#: A field of an order: a number, or bytes of a text from some place on; whether the largest come first.
Field = tuple[Column, int | None, bool]


def _fields(df: DataFrame, order: Order) -> list[Field]:
    """The order as fields without nulls; structs by their fields in turn, each after whether it is null."""

    def parts(c: Column, kind: T.DataType, largest: bool, inner: bool = False) -> list[Field]:
        # Nulls of structs' fields sort first in ascending and last in descending order, those of columns last in both.
        null: Field = (c.isNull().cast("long"), None, inner and not largest)
        if isinstance(kind, T.StructType):
            return [null, *[x for f in kind.fields for x in parts(c[f.name], f.dataType, largest, True)]]
        if isinstance(kind, T.StringType):
            return [null, (c.cast("binary"), 0, largest)]
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            ends = F.when(F.isnan(c), 2).when(c == float("inf"), 1).when(c == float("-inf"), -1).otherwise(0)
            return [null, (ends.cast("long"), None, largest), (F.when(ends == 0, c.cast("double")).otherwise(0.0), None, largest)]
        if isinstance(kind, T.TimestampType):
            return [null, (F.unix_micros(c), None, largest)]
        if isinstance(kind, T.TimestampNTZType):  # read off the clock, so that no zone's clock change makes two moments one
            clock = F.hour(c) * 3600 + F.minute(c) * 60
            micros = (F.unix_date(c.cast("date")).cast("long") * 86_400 + clock) * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
            return [null, (micros, None, largest)]
        if isinstance(kind, T.DateType):
            return [null, (F.unix_date(c).cast("long"), None, largest)]
        if isinstance(kind, (T.IntegralType, T.BooleanType)):
            return [null, (c.cast("long"), None, largest)]
        raise TypeError(f"no deep page is ordered by {kind.simpleString()}")

    return [x for name, largest in order for x in parts(F.col(name), df.schema[name].dataType, largest)]


def _near(df: DataFrame, start: int, stop: int, rows: int, fields: list[Field]) -> tuple[list[DataFrame], int]:
    """Parts of df (of so many rows) that hold places start to stop and little else, and how many rows lie before them."""
    if rows <= stop - start + SHALLOW or not fields:
        return [df], 0
    (c, place, largest), rest = fields[0], fields[1:]
    if place is not None:  # seven bytes of a text at a time, then its length
        digits = F.rpad(F.hex(F.substring(c, 7 * place + 1, 7)), 14, "0")
        longer = df.agg(F.max(F.octet_length(c))).first()[0] or 0
        rest = [(c, place + 1, largest) if longer > 7 * (place + 1) else (F.octet_length(c).cast("long"), None, largest), *rest]
        c = F.conv(digits, 16, 10).cast("long")
    low, high = df.agg(F.min(c), F.max(c)).first()
    if low is None or low == high:
        return _near(df, start, stop, rows, rest)
    if isinstance(low, float):
        cell, again = F.floor((c - low) / (high - low) * (1 << CELL_BITS)), fields
    else:
        shift = max(0, (high - low).bit_length() - CELL_BITS)
        cell, again = F.call_function("shiftright", c, F.lit(shift)), rest if not shift else [(c, None, largest), *rest]
    counts = {r.c: r["count"] for r in df.groupBy(cell.alias("c")).count().collect()}
    whole, parts, before, at = [], [], None, 0
    for k in sorted(counts, reverse=largest):
        first, last = max(start - at, 0), min(stop - at, counts[k])
        if first < last:
            if last - first == counts[k]:
                whole.append(k)
                skipped = 0
            else:
                held, skipped = _near(df.where(cell == k), first, last, counts[k], again)
                parts += held
            before = at + skipped if before is None else before
        at += counts[k]
    if whole:
        parts.append(df.where(cell.isin(whole)))
    return parts, before or 0


def search(
    listings: DataFrame, query: Query, bridge: DataFrame | None = None, order: Order | Sequence[Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(the page in order, one row with the total over every page)."""
    matched = listings.filter(where(query))
    if query.query_key and bridge is not None:
        matched = restrict_to_search(matched, bridge, query.query_key)
    total = matched.agg(F.count("*").alias("total"))
    return page(matched, query.limit, query.offset, order or NEWEST), total


def find(listings: DataFrame, tracker: str, listing_id: int) -> DataFrame:
    """One row by source and id; empty when that source has no such row."""
    return listings.filter((F.col("tracker") == tracker) & (F.col("id") == listing_id)).limit(1)


def recent(listings: DataFrame, n: int, order: Sequence[Column] | None = None) -> DataFrame:
    """Newest n of each source. Spark keeps at most n per source and task before the shuffle."""
    rank = F.row_number().over(W.partitionBy("tracker").orderBy(*(order or newest_first())))
    return listings.withColumn("rank", rank).filter(F.col("rank") <= n)


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{Nd}_]+"), lambda w: w != "")


def and_match(title: Column, keywords: Column, limit: int = 0) -> Column:
    """Every word of the keywords is in the title; single characters and and/the/an do not count."""
    text = F.substring(keywords, 1, limit) if limit > 0 else keywords
    counted = F.filter(split_words(text), lambda w: (F.length(w) > 1) & ~F.lower(w).isin("and", "the", "an"))
    return F.forall(counted, lambda w: F.contains(F.lower(title), F.lower(w)))


# --- many searches at once ------------------------------------------------------------

GRAM = 3


def grams(c: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    size = F.length(c)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(c, i, F.lit(n))))


#: External ids a search may name, as columns of the listings.
ID_COLUMNS = ("doubanid", "imdbid", "rageid", "tmdbid", "traktid", "tvdbid", "tvmazeid")


def _bare_id(c: Column, column: str) -> Column:
    """An external id without leading zeros (and an imdb id without its letters)."""
    text = F.coalesce(c, F.lit(""))
    return F.ltrim(F.regexp_replace(text, "^tt", "") if column == "imdbid" else text, F.lit("0"))


def _canonical(requests: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """Requests with the parts that decide their answer in one form, so that equal searches are equal values."""
    nothing = F.array().cast("array<string>")

    def words(name: str) -> Column:
        if name not in requests.columns:
            return nothing
        folded = F.transform(F.coalesce(F.col(name), nothing), lambda t: F.lower(t))
        return F.filter(F.array_sort(F.array_distinct(folded)), lambda t: t != "")

    def exact(name: str) -> Column:
        return F.array_sort(F.array_distinct(F.coalesce(F.col(name), nothing)))

    # Ids only decide searches without terms.
    id_of = {c: F.when(F.size(words("terms")) == 0, _bare_id(F.try_element_at("ids", F.lit(c)), c)).otherwise("") for c in id_columns}
    ids = F.struct(F.lit("").alias("none"), *[v.alias(c) for c, v in id_of.items()])
    key = F.coalesce(F.col("query_key"), F.lit("")) if "query_key" in requests.columns else F.lit("")
    return requests.select(
        "request_id",
        F.greatest(F.col("limit").cast("bigint"), F.lit(0)).alias("limit"),
        F.greatest(F.col("offset").cast("bigint"), F.lit(0)).alias("offset"),
        F.struct(
            words("terms").alias("terms"),
            words("unsearched_terms").alias("unsearched"),
            exact("categories").alias("categories"),
            exact("trackers").alias("trackers"),
            F.coalesce("needs_category", F.lit(False)).alias("needs_category"),
            ids.alias("ids"),
            key.alias("query_key"),
        ).alias("search"),
    )


def _cell(place: Column) -> Column:
    """Places in cells that widen with depth: sixteen to each doubling, so a cell is at most a sixteenth of what lies before it."""
    q = place + 1
    power = F.length(F.bin(q)) - 1
    return (power * 16 + F.call_function("shiftright", q * 16, power) - 16).cast("int")


def _placed(rows: DataFrame, order: Sequence[str], name: str, columns: Sequence[Column]) -> DataFrame:
    """columns of rows, stored, with every row's place from 0 in the one order of all searches, and the cell of that place.

    Rows are dealt by range and sorted where they land; only one count per partition reaches the driver. The columns are
    made where a row lands, so what several of them hold is moved once, and what only the order needs is not stored.
    """
    by = [F.col(c).desc_nulls_last() for c in order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    kept = written(dealt.select(*columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), name)
    starts, before = [], 0
    for part in kept.groupBy("_part").count().orderBy("_part").collect():
        starts += [F.lit(part._part), F.lit(before)]
        before += part["count"]
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    place = (F.element_at(F.create_map(*starts), F.col("_part")) + at).cast("bigint") if starts else at
    return kept.withColumn("place", place).withColumn("cell", _cell(F.col("place"))).drop("_part", "_at")


def _match_names(wanted: DataFrame, names: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(tid, names): how many names each set of terms in wanted (tid, terms) has; and what gives (tid, folded), the names of some sets.

    Inverted index: each set is looked up by its rarest gram only, where rare is
    counted over the distinct names; the candidates are verified inside the join, so
    neither all pairs nor unverified pairs are ever written out. A term shorter than a trigram
    is its own gram; names are cut into grams of those lengths only if some set is sought by one.
    """
    gram_of = F.flatten(F.transform("terms", lambda t: F.when(F.length(t) >= GRAM, grams(t, GRAM)).otherwise(F.array(t))))
    sought = wanted.select("tid", F.explode(F.array_distinct(gram_of)).alias("gram"))
    # A set with any whole trigram is sought by its trigrams alone: shorter grams are never rarer than needed.
    long = sought.groupBy("tid").agg(F.max(F.length("gram")).alias("longest"))
    sought = sought.join(long, "tid").where(F.length("gram") == F.col("longest")).drop("longest")
    needed = sought.select("gram").distinct()
    lengths = sorted(r.n for r in needed.select(F.length("gram").alias("n")).distinct().collect())  # at most 1, 2 and 3
    pieces = F.flatten(F.array(*[grams(F.col("folded"), n) for n in lengths])) if lengths else F.array().cast("array<string>")
    index = names.select("folded", F.explode(pieces).alias("gram")).join(needed, "gram", "left_semi")
    frequency = index.groupBy("gram").agg(F.count("*").alias("names"))
    # A gram no name has makes the search empty; min_by over counts picks it as 0.
    held = F.struct(F.coalesce("names", F.lit(0).cast("bigint")), F.col("gram"))
    rarest = written(sought.join(frequency, "gram", "left").groupBy("tid").agg(F.min_by("gram", held).alias("gram")).join(wanted, "tid"), "search-grams")

    def verified(chosen: DataFrame) -> DataFrame:
        same = (F.col("i.gram") == F.col("c.gram")) & F.expr("forall(c.terms, t -> contains(i.folded, t))")
        return index.alias("i").join(chosen.alias("c"), same).select("c.tid", "i.folded")

    counts = verified(rarest).groupBy("tid").agg(F.count("*").alias("names"))
    return counts, lambda chosen: verified(rarest.join(chosen, "tid", "left_semi"))


#: Pairs looked at inside a join cost about this share of a pair that is written out.
LOOK = 0.1


def search_many(
    requests: DataFrame,
    listings: DataFrame,
    order: Sequence[str] = ("published", "id"),
    keep: Sequence[str] = ("tracker", "identity", "name", "published"),
    bridge: DataFrame | None = None,
) -> DataFrame:
    """(request_id, rank, total, *keep): the page of every request, however deep it lies.

    requests: request_id, terms array, categories array, trackers array (empty = all), needs_category,
    limit, offset, and if present unsearched_terms array, ids map<string,string> and query_key.
    bridge: (tracker, identity, search_key), the searches that produced each managed listing.

      1. Equal searches are one value, answered once, as deep as the deepest request for it asks; equal sets of
         terms are matched to names once.
      2. All rows get their place in the one order of all pages by a range sort, and the cell of that place.
      3. A first pass counts each search's rows per cell, combined where they are found: totals, and the cell in which the
         search's depth is reached. No pair of a search and a row is written.
      4. A second pass brings only rows of cells up to that one, a sixteenth more than the page is deep, and ranks them.

    Each search takes the cheaper way to its rows: through the names that hold its terms, or, for terms
    that many names hold, through its sources (all cells, without any) with the terms tested inside the join. Searches
    without terms are counted on shelves, rows no search can tell apart but by place. A search by id meets unmanaged rows
    by the id itself; managed rows, which no id turns away, are counted once for all searches that differ in ids only.
    Before rows are moved to meet searches, those whose source, cell or name no search asks for are left out.
    """
    ids = [c for c in ID_COLUMNS if c in listings.columns] if "ids" in requests.columns else []
    keyed = "query_key" in requests.columns and bridge is not None
    canonical = _canonical(requests, ids)
    searches = canonical.groupBy("search").agg(F.max(F.col("limit") + F.col("offset")).alias("depth"))
    searches = written(searches.select("search.*", "depth").withColumn("sig", F.monotonically_increasing_id()), "searches")

    managed = F.coalesce(F.col("search_managed"), F.lit(False)) if "search_managed" in listings.columns else F.lit(False)
    rows = listings.withColumns({"cats": F.col("categories").cast("array<string>"), "managed": managed})
    if keyed:
        produced = bridge.groupBy("tracker", "identity").agg(F.array_sort(F.collect_set("search_key")).alias("keys"))
        known = rows.where("managed").join(produced, ["tracker", "identity"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
        rows = rows.where("NOT managed").withColumn("keys", F.lit(None).cast("array<string>")).unionByName(known)
    rows = rows.withColumns({f"bare_{c}": F.when(~F.col("managed"), _bare_id(F.col(c), c)) for c in ids})
    shelf = ["tracker", "cats", "managed", *(["keys"] if keyed else []), *[f"bare_{c}" for c in ids]]
    moved = {c: c if c in shelf else f"_{c}" for c in dict.fromkeys(["name", *keep, *order])}
    slim = rows.select(*shelf, *[F.col(c).alias(m) for c, m in moved.items() if c not in shelf])
    made = [F.lower(F.col(moved["name"])).alias("folded"), *[F.col(c) for c in shelf], F.struct(*[F.col(moved[c]).alias(c) for c in keep]).alias("row")]
    placed = _placed(slim, [moved[c] for c in order], "search-rows", made)
    shelves = written(placed.groupBy(*shelf, "cell").agg(F.count("*").alias("n")), "search-shelves")

    def holds() -> Column:
        """Unmanaged rows must hold one of the ids a search without terms names, and contradict none."""
        named = [(F.col(f"ids.{c}"), F.col(f"bare_{c}")) for c in ids]
        if not named:
            return F.lit(True)
        some = reduce(lambda a, b: a | b, [(want != "") & (want == have) for want, have in named])
        clean = reduce(lambda a, b: a & b, [(want == "") | (have == "") | (want == have) for want, have in named])
        unnamed = reduce(lambda a, b: a & b, [want == "" for want, _ in named])
        return unnamed | (F.size("terms") > 0) | F.col("managed") | (some & clean)

    suits = F.expr(
        "(size(trackers) = 0 OR array_contains(trackers, tracker))"
        " AND (size(categories) = 0 OR size(cats) = 0 OR arrays_overlap(categories, cats))"
        " AND (NOT needs_category OR size(cats) > 0)"
    )
    if keyed:
        suits = suits & ((F.col("query_key") == "") | ~F.col("managed") | F.array_contains("keys", F.col("query_key")))
    fits = suits & holds()
    unsought = F.expr("managed OR forall(unsearched, t -> contains(folded, t))")
    holding = F.expr("forall(terms, t -> contains(folded, t))")

    # The way of each search: names, its id, rows of its sources, or shelves.
    sets = written(searches.where(F.size("terms") > 0).select("terms").distinct().withColumn("tid", F.monotonically_increasing_id()), "search-terms")
    names = placed.select("folded").distinct()
    many, verified = _match_names(sets, names)
    stocked = shelves.groupBy("tracker").agg(F.sum("n").alias("stock"))
    all_rows = stocked.agg(F.coalesce(F.sum("stock"), F.lit(0).cast("bigint")).alias("all_rows"))
    asked_of = searches.where((F.size("terms") > 0) & (F.size("trackers") > 0)).select("sig", F.explode("trackers").alias("tracker"))
    stock = asked_of.join(stocked, "tracker").groupBy("sig").agg(F.sum("stock").alias("stock"))
    sizes = names.agg(F.count("*").alias("all_names")).first()[0], all_rows.first()[0]  # two numbers
    through = F.coalesce("names", F.lit(0)) * (sizes[1] / max(sizes[0], 1))
    source_rows = F.when(F.size("trackers") == 0, F.lit(sizes[1])).otherwise(F.coalesce("stock", F.lit(0).cast("bigint")))
    by_some_id = reduce(lambda a, b: a | b, [F.col(f"ids.{c}") != "" for c in ids], F.lit(False))  # terms leave no id
    way = F.when(by_some_id, "id").when((F.size("terms") == 0) & (F.size("unsearched") == 0), "shelf").when((F.size("terms") == 0) | (LOOK * source_rows <= through), "source").otherwise("name")
    planned = written(searches.join(sets, "terms", "left").join(many, "tid", "left").join(stock, "sig", "left").withColumn("way", way).drop("names", "stock"), "search-ways")
    by_name, by_id, by_source, by_shelf = (planned.where(F.col("way") == w) for w in ("name", "id", "source", "shelf"))
    matched = written(verified(by_name.select("tid").distinct()), "search-names")

    def met(asked: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
        """asked joined with kept by keys; rows under keys that nobody asks for are not moved where the keys are few enough to broadcast."""
        sought = written(asked.select(*keys).distinct(), "search-keys")
        return asked.join(kept.join(sought, keys, "left_semi"), keys)

    def of_sources(asked: DataFrame, kept: DataFrame, fit: Column, cells: DataFrame | None) -> DataFrame:
        """asked met with kept rows: those of named sources by source (and cell), those of all sources by cell."""
        if cells is None:  # the first pass: all cells there are
            everywhere = asked.where(F.size("trackers") == 0).withColumn("cell", F.explode(F.array(*[F.lit(c) for c in open_cells]).cast("array<int>")))
            named, keys = asked.where(F.size("trackers") > 0), ["source"]
        else:
            asked = asked.join(cells, "sig")
            everywhere, named, keys = asked.where(F.size("trackers") == 0), asked.where(F.size("trackers") > 0), ["source", "cell"]
        named = named.withColumn("source", F.explode("trackers"))
        a = met(everywhere, kept, ["cell"]).where(fit)
        b = met(named, kept.withColumn("source", F.col("tracker")), keys).where(fit).drop("source")
        return a.unionByName(b, allowMissingColumns=True)

    def of_ids(asked: DataFrame, kept: DataFrame, fit: Column) -> DataFrame:
        """asked met with unmanaged rows that hold an id they name, by the id and the sources asked; once by the first id both have."""

        def spelled(prefix: str) -> Column:
            each = [F.when(F.col(f"{prefix}{c}") != "", F.concat(F.lit(f"{c}="), F.col(f"{prefix}{c}"))) for c in ids]
            return F.array_compact(F.array(*each))

        a, b = asked.withColumn("held", F.explode(spelled("ids."))), kept.where("NOT managed").withColumn("held", F.explode(spelled("bare_")))
        once = fit & (F.col("held") == F.get(F.array_intersect(spelled("ids."), spelled("bare_")), F.lit(0)))
        everywhere = met(a.where(F.size("trackers") == 0), b, ["held"]).where(once)
        named = a.where(F.size("trackers") > 0).withColumn("source", F.explode("trackers"))
        return everywhere.unionByName(met(named, b.withColumn("source", F.col("tracker")), ["held", "source"]).where(once).drop("source"))

    open_cells = sorted(r.cell for r in shelves.select("cell").distinct().collect())  # some hundred numbers
    one = F.lit(1).cast("bigint")
    counted = [
        matched.join(by_name, "tid").join(placed, "folded").where(fits & unsought).select("sig", "cell", one.alias("n")),
        of_sources(by_source, placed, fits & unsought & holding, None).select("sig", "cell", one.alias("n")),
        of_sources(by_shelf, shelves, fits, None).select("sig", "cell", "n"),
    ]
    if ids:
        alike = ["trackers", "categories", "needs_category", "query_key"]
        classes = written(by_id.select(*alike).distinct().withColumn("class", F.monotonically_increasing_id()), "search-classes")
        taken = of_sources(classes, shelves.where("managed"), suits, None).groupBy("class", "cell").agg(F.sum("n").alias("n"))
        counted += [
            by_id.join(classes, alike).select("sig", "class").join(taken, "class").select("sig", "cell", "n"),
            of_ids(by_id, placed, fits & unsought).select("sig", "cell", one.alias("n")),
        ]
    counts = reduce(lambda x, y: x.unionByName(y), [c.groupBy("sig", "cell").agg(F.sum("n").alias("n")) for c in counted])
    # At most some hundred cells a search: their running sum tells where its depth is reached.
    cells = W.partitionBy("sig").orderBy("cell")
    before = F.coalesce(F.sum("n").over(cells.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    counts = written(counts.withColumns({"before": before, "total": F.sum("n").over(W.partitionBy("sig"))}), "search-counts")
    needed = counts.join(searches.select("sig", "depth"), "sig").where(F.col("before") < F.col("depth")).select("sig", "cell")
    deepest = needed.groupBy("sig").agg(F.max("cell").alias("last"))
    reached = matched.join(by_name, "tid").join(deepest, "sig")
    reach = written(reached.groupBy("folded").agg(F.max("last").alias("reach")), "search-reach")
    within = placed.join(reach, "folded").where(F.col("cell") <= F.col("reach")).drop("reach")
    found = [
        reached.join(within, "folded").where((F.col("cell") <= F.col("last")) & fits & unsought),
        # Shelves leave no term to test; a search by id takes its managed rows here.
        of_sources(planned.where(F.col("way") != "name"), placed, fits & unsought & holding & ((F.col("way") != "id") | F.col("managed")), needed),
    ]
    if ids:
        found.append(of_ids(by_id.join(deepest, "sig"), placed, fits & unsought).where(F.col("cell") <= F.col("last")))
    hits = reduce(lambda x, y: x.unionByName(y), [f.select("sig", "place", "row") for f in found])
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("sig").orderBy("place"))).join(counts.groupBy("sig").agg(F.first("total").alias("total")), "sig")
    parts = [c for c in searches.columns if c not in ("sig", "depth")]
    asked = canonical.select("request_id", "limit", "offset", "search.*")
    signed = asked.join(searches, parts).select("request_id", "sig", "limit", "offset")
    return (
        signed.join(ranked, "sig")
        .where((F.col("rank") > F.col("offset")) & (F.col("rank") <= F.col("offset") + F.col("limit")))
        .select("request_id", (F.col("rank") - F.col("offset")).cast("int").alias("rank"), "total", *[F.col(f"row.{c}").alias(c) for c in keep])
    )
