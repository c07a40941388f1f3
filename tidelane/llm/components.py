"""Groups of linked ids, found without any group ever meeting in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bits of the filter that goes ahead of joins, and how many numbers of 64 bits a row of it has.
FILTER_BITS, FILTER_NUMBERS = 1 << 26, 8
#: Ids of a bucket from which on it is made finer.
BLOCK = 64
#: Ids of a bucket that meet as many others at once.
SIDE = 1024


def with_least(edges: DataFrame, key: str, value: str) -> DataFrame:
    """``edges`` (key, value) plus m, the least value of the key.

    The least values are a table of their own, so both sides of the join are plain exchanges: where a key has
    many rows, adaptive execution splits its partition, and where the table is small, it is broadcast.
    """
    least = stored(edges.groupBy(F.col(key).alias("c_")).agg(F.min(value).alias("m")))
    return edges.join(least, F.col(key) == F.col("c_")).select(*edges.columns, "m")


def _stars(edges: DataFrame) -> bool:
    """Whether each id of ``edges`` (u, v) is either the end of one edge alone or a centre."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("n")), F.struct(F.col("v").alias("id"), F.lit(0).alias("n")))).alias("e"))
    ends = ends.groupBy("e.id").agg(F.sum("e.n").alias("n"), F.min("e.n").alias("lo"))
    return ends.where("n > 1 or (n = 1 and lo = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id that ``links`` (a, b) names; component is the smallest id reachable.

    Large-star and small-star steps take turns until all edges lead to a centre. A step sends each neighbour to
    the smallest id seen, by grouping and joining, so a hub of any degree is spread over tasks. Links of an id
    with itself say nothing and are dropped; the empty table gives an empty table.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = stored(large.where("u > v").distinct())
        # after the first step an id has few smaller neighbours, so none is hot here
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(least, large.u == least.c).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u > v").distinct())
    ends = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(ends)


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) of ``found`` (id, component) after ``links`` (a, b) more; ids that only ``links`` has are added.

    Only what ``found`` calls components is joined anew, so a few links cost a few rows a step.
    """

    def at(end: str) -> DataFrame:
        return found.select(F.col("id").alias(f"{end}_id"), F.col("component").alias(f"{end}_c"))

    ends = links.join(at("a"), F.col("a") == F.col("a_id"), "left").join(at("b"), F.col("b") == F.col("b_id"), "left")
    joined = stored(components(ends.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))))
    moved = joined.select(F.col("id").alias("old"), F.col("component").alias("new"))
    return found.join(moved, found.component == moved.old, "left").select("id", F.coalesce("new", "component").alias("component")).unionByName(joined.join(found.select("id"), "id", "left_anti"))


def marked_likely(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` with column likely_: whether ``key`` may be among ``keys`` (k). It is true for all of ``keys``, and for few others.

    A bit for each of FILTER_BITS hash values, FILTER_NUMBERS times 64 to a row: however many keys there are, the
    broadcast table has a row for each at most.
    """
    own = 64 * FILTER_NUMBERS

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))

    def number(i: int) -> str:
        return f"p_ div 64 % {FILTER_NUMBERS} = {i}"

    bits = [F.expr(f"bit_or(case when {number(i)} then shiftleft(1L, cast(p_ % 64 as int)) else 0L end)").alias(f"bits{i}_") for i in range(FILTER_NUMBERS)]
    words = keys.select(place("k").alias("p_")).groupBy(F.expr(f"p_ div {own}").alias("word_")).agg(*bits)
    at = df.withColumn("p_", place(key)).join(F.broadcast(words), F.expr(f"p_ div {own} = word_"), "left")
    asked = f"case {' '.join(f'when {number(i)} then bits{i}_' for i in range(FILTER_NUMBERS))} end"
    return at.withColumn("likely_", F.expr(f"coalesce(getbit({asked}, cast(p_ % 64 as int)) = 1, false)")).drop("p_", "word_", *[f"bits{i}_" for i in range(FILTER_NUMBERS)])


def likely_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among ``keys`` (k), by ``marked_likely``: a filter ahead of a join, so that fewer rows are shuffled."""
    return marked_likely(df, key, keys).where("likely_").drop("likely_")


def pairs_in_blocks(rest: DataFrame, near: Callable[[Column, Column], Column], size_class: Callable[[Column], Column]) -> DataFrame:
    """(a, b): the pairs of ``rest`` (key, id, load, component) that share a key, are of different components and ``near``.

    ``size_class`` makes a number of a load that differs by at most 1 between near ids, so a key falls into parts
    of two neighbouring classes. In a part, ids of its largest component have nothing to ask each other: every
    pair has an end in another component. Those of other components are dealt to rows of a grid and all ids to its
    columns, SIDE to each on average, and either are copied along theirs: of x and y ids 2xy / SIDE copies are moved, and
    many copies of one thing cost a row each. A task never holds more of a part than SIDE ids at once, and only pairs that are near become rows. Where ``rest`` has the columns of ``finer``,
    a pair that shares half of its parts comes once, by the first part it shares, and others do not come by these keys.
    """
    own = ["ranked", "place"] if "ranked" in rest.columns else []
    d = rest.withColumn("class_", size_class(F.col("load"))).withColumn("part", F.explode(F.array(F.col("class_") - 1, F.col("class_"))))
    held = d.groupBy(F.col("key").alias("k"), F.col("part").alias("p"), "component").agg(F.count("*").alias("n"))
    held = held.groupBy("k", "p").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("c")).where("c > 1")
    held = held.select("k", "p", "largest", F.ceil((F.col("n") - F.col("most")) / SIDE).alias("rows_"), F.ceil(F.col("n") / SIDE).alias("columns_"))
    held = stored(held.withColumn("both_", F.xxhash64("k", "p")))
    d = likely_in(d.withColumn("both_", F.xxhash64("key", "part")), "both_", held.select(F.col("both_").alias("k"))).drop("both_")
    d = stored(d.join(held.drop("both_"), (F.col("key") == F.col("k")) & (F.col("part") == F.col("p"))).drop("k", "p"))

    def dealt(to: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(to))

    def each(to: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(to) - 1))

    x = d.where("component <> largest").select("key", "part", dealt("rows_").alias("row_"), each("columns_").alias("column_"), "id", "load", "component", "class_", *own)
    y = d.select(F.col("key").alias("k2"), F.col("part").alias("p2"), each("rows_").alias("r2"), dealt("columns_").alias("c2"), F.col("id").alias("y"), F.col("load").alias("ly"), F.col("component").alias("cy"), F.col("class_").alias("class_y"), "largest", *[F.col(c).alias(f"{c}_y") for c in own])
    apart = (F.col("component") < F.col("cy")) | ((F.col("cy") == F.col("largest")) & (F.col("component") > F.col("cy")))
    once = F.least("class_", "class_y") == F.col("part")  # two ids of one class share two parts
    pair = apart & once & near(F.col("load"), F.col("ly"))
    if own:
        both = F.array_intersect("ranked", "ranked_y")
        common = F.ceil(F.least(F.size("ranked"), F.size("ranked_y")) / 2)
        pair &= F.when(F.col("ranked").isNull() | F.col("ranked_y").isNull(), F.lit(True)).otherwise((F.get(both, F.lit(0)) == F.col("place")) & (F.size(both) >= common))
    met = x.join(y, (F.col("key") == F.col("k2")) & (F.col("part") == F.col("p2")) & (F.col("row_") == F.col("r2")) & (F.col("column_") == F.col("c2")) & pair)
    return met.select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b"))


def finer(rest: DataFrame, parts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rest`` (key, id, load, component) with keys of more than BLOCK ids replaced by finer ones, plus ranked and place, null at keys that stay.

    ``parts`` takes ids (id) and returns (id, parts), distinct values of which near ids share half of the fewer
    at least. ranked has the parts of an id, numbered so that rare ones come first in one order for all ids. Two
    ids that share s of their parts have the first that they share among all but their last s - 1, and s need be half
    of the fewer only. So an id's keys are its parts, each as place, but for the last ones that no id of few parts has;
    it has them once, however many of its keys are large.
    """
    n = stored(rest.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("k"))
    none = {"ranked": F.lit(None).cast("array<bigint>"), "place": F.lit(None).cast("bigint")}
    if n.isEmpty():
        return rest.withColumns(none)
    crowded = rest.join(n, F.col("key") == F.col("k")).groupBy("id").agg(F.first("load").alias("load"), F.min("component").alias("component"))
    crowded = stored(crowded)
    own = parts(crowded.select("id")).select(F.col("id").alias("pid"), "parts")
    held = stored(crowded.join(own, F.col("id") == F.col("pid")).select("id", "load", "component", "parts"))
    often = stored(held.select(F.explode("parts").alias("op")).groupBy("op").agg(F.count("*").alias("often")))
    # how often, then the part itself, in one number
    number = F.expr("shiftleft(least(often, 1048575L), 43) | (op & 8796093022207L)")
    ranked = held.select("id", F.explode("parts").alias("part")).join(often, F.col("part") == F.col("op")).groupBy(F.col("id").alias("rid")).agg(F.sort_array(F.collect_list(number)).alias("ranked"))
    ranked = stored(held.join(ranked, F.col("id") == F.col("rid")).select("id", "load", "component", "ranked", F.expr("cast(ceil(size(ranked) / 2) as int)").alias("half")))
    each = ranked.select("half", "id", "ranked", F.explode(F.expr("sequence(1, half)")).alias("s")).select("id", "half", "s", F.explode(F.expr("slice(ranked, 1, size(ranked) - s + 1)")).alias("place"))
    met = each.groupBy(F.col("s").alias("ms"), F.col("place").alias("mp")).agg(F.count("*").alias("n"), F.min("half").alias("least")).where("n > 1 and least = ms").select("ms", "mp")
    keys = each.join(stored(met), (F.col("s") == F.col("ms")) & (F.col("place") == F.col("mp"))).select(F.col("id").alias("i"), F.xxhash64("place").alias("key"), "place").distinct()
    split = ranked.join(keys, F.col("id") == F.col("i")).select("key", "id", "load", "component", "ranked", "place")
    return stored(rest.join(n, F.col("key") == F.col("k"), "left_anti").withColumns(none).unionByName(split))


def linked_components(
    members: DataFrame,
    near: Callable[[Column, Column], Column],
    prepare: Callable[[DataFrame], tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame] | None]],
    rounds: int = 1,
    parts: Callable[[DataFrame], DataFrame] | None = None,
    size_class: Callable[[Column], Column] = lambda load: F.lit(0),
) -> DataFrame:
    """(id, component) over all verified links between ids that share a bucket.

    ``members`` (key, id, load) lists buckets of candidates, load being what ``near`` needs of an id to
    rule out a pair; ``prepare`` gets the ids (id) that are left and returns (verify, rest): ``verify`` takes pairs
    (a, b), a < b, and returns those that are linked. Only connectivity is asked for, so pairs that are
    connected already need no test. In each round every bucket picks one hub and its members are compared
    with the hub alone; then the hub, which has met all of its bucket, leaves it. What the hubs leave apart is
    compared across the remaining components of a bucket, so no link is lost and no pair of a bucket is tested
    twice; a bucket that the hubs have joined, or with one member left, is through. Without ``rest`` that is done
    by ``pairs_in_blocks`` with ``size_class``, after large buckets are made ``finer`` by ``parts`` where they are given. ``rest`` takes (id, component, family), where ids that share an unsettled bucket, directly or
    through others, are a family, and returns links (a, b) that join whatever components of a family are linked.
    """
    shared = stored(members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(F.col("key").alias("k"), F.col("lo").alias("hub")))
    members = likely_in(members, "key", shared).distinct()
    members = stored(members.join(shared, F.col("key") == F.col("k")).select("key", "id", "load", "hub"))
    verify, settle = prepare(members.select("id").distinct())
    found = None
    unmet = members
    for r in range(rounds + 1):
        if found is None:
            placed = unmet.withColumn("component", F.col("id"))
        else:
            f = found.select(F.col("id").alias("fid"), F.col("component").alias("fc"))
            placed = unmet.join(f, F.col("id") == F.col("fid"), "left").select("key", "id", "load", F.coalesce("fc", "id").alias("component"))
        placed = stored(placed) if r else placed
        if r:
            spread = placed.groupBy("key").agg(
                F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("o"), "id", "load", "component")).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi")
            )
            spread = spread.where("lo < hi").select(F.col("key").alias("k"), F.col("hub.id").alias("y"), F.col("hub.load").alias("ly"), F.col("hub.component").alias("cy"))
        else:  # the first hub, the least id, was found with the buckets
            spread = placed.where("id = hub").select(F.col("key").alias("k"), F.col("id").alias("y"), F.col("load").alias("ly"), F.col("component").alias("cy"))
        # a table of its own, so that a key with many members can be split in the joins
        spread = stored(spread)
        if r:  # most buckets are through by now
            placed = likely_in(placed, "key", spread.select("k"))
        apart = placed.join(spread, F.col("key") == F.col("k"))
        if r < rounds:
            pairs = apart.where("component <> cy").where(near(F.col("load"), F.col("ly"))).select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b"))
            unmet = (apart.where("id <> y") if r else placed.where("id <> hub")).select("key", "id", "load")
        elif settle is None:
            left = stored(apart.select("key", "id", "load", "component"))
            pairs = pairs_in_blocks(left if parts is None else finer(left, parts), near, size_class)
        else:
            rest = stored(apart.select("id", "component", "y"))
            families = components(rest.select(F.col("id").alias("a"), F.col("y").alias("b"))).select(F.col("id").alias("fid"), F.col("component").alias("family"))
            rest = rest.select("id", "component").distinct().join(families, F.col("id") == F.col("fid")).select("id", "component", "family")
            pairs = None
        fresh = stored(settle(rest) if pairs is None else verify(pairs.distinct()))
        if not fresh.isEmpty():
            found = stored(components(fresh) if found is None else merged(found, fresh))
    if found is None:
        return members.select("id", F.col("id").alias("component")).limit(0)
    return found
