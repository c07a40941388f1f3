"""Mix sources to target weights: capped water-filling, then seeded repetitions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unwrapped, word_count, wrapped

#: Rows of a source that one task orders by their draw.
ROWS_A_SLICE = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target) from ``sizes`` (source, size).

    Sources stand by code point, null last, and weigh ``weights`` in turn. They share ``share`` of all sizes;
    a source stops at ``epochs`` times its size and the excess goes to the others by weight until none is
    above. With r = cap / weight ascending, the sources before the first whose r reaches
    level = (total - caps before) / (weights from here) are the clamped ones, so one pass settles it. A
    source of size 0 gets target 0; if the caps cannot hold the total, each target is its cap. The table has
    one row a source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.array(*[F.lit(float(x)) for x in weights])
    by = by.withColumn("weight", F.element_at(w, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    by = by.withColumn("r", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("r", F.col("source").isNull(), "source")
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    done = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    by = by.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    by = by.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("weight").over(rest))
    by = by.withColumn("final", F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "level"))).over(every)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return by.select("source", "source_size", "n_docs", target.alias("target"))


def draw(*values: Column) -> Column:
    """A number in [0, 1) made of the values' text: the first 52 bits of an MD5, which SQL has everywhere."""
    return F.conv(F.left(F.md5(F.concat_ws(":", *[F.coalesce(v.cast("string"), F.lit(" ")) for v in values])), F.lit(13)), 16, 10).cast("double") / F.lit(float(2**52))


def taken_words(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """(source, doc_id, size, source_size, target, taken), a row for each of ``sizes`` (source, doc_id, size).

    target / source_size is a source's repetition rate. Each document is taken floor(rate) times whole; the
    fractional repetition is a draw without replacement: a source's documents stand in the order of a seeded
    hash, and those that begin within frac * source_size are taken once more, the one at the edge in part.
    So a source's words sum to its target, rounded. The order is cut into slices by the hash, whose totals
    are pre-aggregated, so a source of any share is spread over tasks. Equal rows are interchangeable: they
    are counted first and drawn in lots of ROWS_A_SLICE, so that any number of them, null ids of one size
    too, falls into many slices.
    """
    t = stored(source_targets(sizes, weights, share, epochs))
    t = t.select(F.col("source").alias("s_"), "source_size", "n_docs", "target")
    alike = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("alike_"))
    lots = alike.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("alike_") - 1).cast("bigint"), F.lit(ROWS_A_SLICE).cast("bigint"))).alias("first_"))
    lots = lots.withColumn("lot_", F.least(F.col("alike_") - F.col("first_"), F.lit(ROWS_A_SLICE))).withColumn("no_", (F.col("first_") / ROWS_A_SLICE).cast("long"))
    d = lots.join(t, lots.source.eqNullSafe(t.s_)).drop("s_", "alike_", "first_")
    d = d.withColumn("draw_", draw(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("no_")))
    d = d.withColumn("slice_", F.floor(F.col("draw_") * F.ceil(F.col("n_docs") / ROWS_A_SLICE)).cast("long"))
    totals = d.groupBy("source", "slice_").agg(F.sum(F.col("size") * F.col("lot_")).alias("sum_"))
    before = Window.partitionBy("source").orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s_"), F.col("slice_").alias("k_"), F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("offset_"))
    d = d.join(totals, d.source.eqNullSafe(totals.s_) & (d.slice_ == totals.k_)).drop("s_", "k_")
    inner = Window.partitionBy("source", "slice_").orderBy("draw_", "doc_id", "size", "no_").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start_", F.col("offset_") + F.coalesce(F.sum(F.col("size") * F.col("lot_")).over(inner), F.lit(0)))
    d = d.withColumn("place_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lot_") - 1)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    quota = F.round(F.col("target")).cast("long") - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), quota - F.col("start_") - F.col("place_") * F.col("size")))
    return d.select("source", "doc_id", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of ``docs``; size counts words, 0 for null text."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each of ``docs``."""
    d = taken_words(stored(document_sizes(docs)), **parameters)
    return d.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken.

    A document taken n times whole appears n times; one at the edge appears once more with its first words
    only, up to the blanks after the last word taken. n_chars, where there is one, follows the text. Rows that
    agree in doc_id, source and size are taken alike.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("source").isNull(), F.col("source"), F.col("size"))
    taken = taken_words(stored(document_sizes(docs)), **parameters)
    taken = taken.where("taken > 0").groupBy(key.alias("taken_key_")).agg(F.max("taken").alias("taken_"))
    rows = wrapped(docs, "doc_id", "source", "text").withColumn("size", word_count(F.col("text")))
    rows = rows.join(taken, key == F.col("taken_key_"))
    over = (F.col("taken_") % F.col("size")).cast("int")
    pieces = F.split(F.col("text"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    head = F.when(over > 0, F.array_join(F.slice(pieces, F.lit(1), over + lead), ""))
    copies = F.array_repeat(F.col("text"), F.floor(F.col("taken_") / F.col("size")).cast("int"))
    rows = rows.withColumn("new_", F.explode(F.concat(copies, F.when(over > 0, F.array(head)).otherwise(F.array().cast("array<string>")))))
    return unwrapped(rows, docs, {"text": F.col("new_"), "n_chars": F.char_length("new_").cast("long")})


def sql(weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> str:
    """The rows of ``mix`` in DuckDB's SQL: each source as one running sum over its documents."""
    listed = ", ".join(str(float(w)) for w in weights)
    return f"""with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from documents),
sources as (select source, sum(size)::bigint as source_size, [{listed}]::double[] as w, row_number() over (order by source is null, source) as i from sized group by source),
caps as (select source, source_size, w[(i - 1) % len(w) + 1] as weight, source_size * {float(epochs)}::double as cap from sources),
levels as (select *, cap / weight as r, (sum(source_size) over ()::double * {float(share)} - coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0))
 / sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) as level from caps),
final as (select (min({{'r': r, 'l': level}}) filter (where level <= r)).l as f from levels),
targets as (select source, source_size, case when f is null then cap else least(cap, f * weight) end as target from levels, final),
lots as (select *, (row_number() over (partition by source, doc_id, size) - 1) as place from sized),
drawn as (select *, ('0x' || left(md5('{seed}:' || coalesce(doc_id::varchar, ' ') || ':' || size || ':' || place // {ROWS_A_SLICE}), 13))::bigint as draw from lots),
begun as (select *, coalesce(sum(size) over (partition by source order by draw, doc_id nulls first, size, place rows between unbounded preceding and 1 preceding), 0)::bigint as start from drawn),
rates as (select *, case when source_size > 0 then floor(target / source_size + 1e-12)::bigint else 0 end as whole from targets)
select doc_id, size::bigint as size, source_size, target, whole * size + greatest(0, least(size, round(target)::bigint - whole * source_size - start)) as taken
from begun b join rates r on b.source is not distinct from r.source"""
