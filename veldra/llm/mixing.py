"""Mixing sources to target weights along a time-varying curriculum.

Each source ``s`` has a weight schedule that runs linearly from ``w0`` at the start of training to
``w1`` at its end. Its cumulative demand after the share ``t`` of training is the integral of the
schedule, ``D(t) = target * (a t + b t^2)`` with ``a + b = 1``. A document that stands at a given
word of its source's stream is trained when that demand is reached, so inverting ``D`` gives its
position; documents are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm.common import ASCII_SPACE, bucket_count, materialize, n_words

WEIGHTS, MAX_REPEAT = (5, 2, 1), 3
#: Start of each source's schedule relative to its mean, repeating by source rank: heavier early, even, heavier late.
RAMP = (1.5, 1.0, 0.5)


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, source_size, source_rank, target)`` for rows of ``(source, size)``.

    Sources in code point order, null last, weigh 5, 2, 1, repeating. A target is
    ``min(weight * level, max_repeat * source_size)`` where the level makes targets add up to all
    sizes: the fixed point of resharing the excess by weight. The level follows from one pass over
    sources sorted by ``cap / weight``; the table has a row for each source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("source_rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("w", weight).withColumn("cap", F.lit(max_repeat) * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "source_rank")
    everything = Window.partitionBy()
    level = (
        caps.withColumn("capped_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_from", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("w_from"))
        # The first source in this order whose cap is not reached sets the level of all after it.
        .withColumn("free", F.col("cap") >= F.col("w") * F.col("level"))
        .withColumn("final", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "source_rank", "level"))).over(everything)["level"])
    )
    target = F.least(F.col("cap"), F.col("w") * F.coalesce("final", F.lit(0.0)))
    return level.select("source", F.col("source_size").cast("long").alias("source_size"), "source_rank", target.alias("target"))


def position(words: Column, target: Column, start: Column) -> Column:
    """The share of training at which ``words`` of a source's ``target`` have been asked for.

    Inverts ``a t + b t^2 = words / target`` with ``a = start`` and ``b = 1 - start``.
    """
    y = F.least(F.lit(1.0), F.greatest(F.lit(0.0), words / target))
    b = F.lit(1.0) - start
    root = (2 * y) / (start + F.sqrt(F.greatest(start * start + 4 * b * y, F.lit(0.0))))
    return F.when(target > 0, F.least(F.lit(1.0), root))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken, uses`` and ``position``.

    A source's stream holds its documents in the order of ``md5(doc_id)``; the mix takes the stream's
    first ``round(target)`` words, starting over when it ends, so a document is taken whole for each
    full pass, and in the last pass whole, in part (where the stream is cut) or not at all. ``uses`` is
    an array of ``(epoch, words, position)``, one for each pass that takes words.

    Places in a stream come from sums by bucket of the order, prefix sums over buckets and a window
    within a bucket, so the hottest source is spread over as many tasks as it has buckets.

    Null or empty text has size 0 and is taken 0 times. A null source is a source of its own, last in
    order. Null and repeated ``doc_id`` are ordinary rows: equal ones lie beside each other, ordered by size
    and by a hash of the text, so that reruns agree. A very long text is a row like others; an empty table
    gives no rows. Extra columns pass through; those named like results are replaced. The table of sources
    and targets is sorted in one task: a row for each source.
    """
    made = ["size", "source_size", "source_rank", "target", "taken", "uses", "position"]
    base = docs.drop(*[c for c in docs.columns if c in made])
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = base.withColumn("size", n_words(F.col("text"))).withColumns({"__v_order": order, "__v_tie": F.xxhash64("text")})
    fine = F.conv(F.substring("__v_order", 1, 4), 16, 10).cast("long")
    # What follows reads sums by source and 65,536th of the order, never the texts again.
    sums = materialize(sized.groupBy("source", fine.alias("__v_fine")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("__v_rows")), "mix-sums")
    buckets = bucket_count(sums.agg(F.sum("__v_rows")).first()[0] or 0)

    def bucket(place: Column) -> Column:
        # Buckets are ranges of the order, so that prefix sums over them respect it.
        return F.floor(place * buckets / 65_536).cast("long")

    targets = materialize(source_targets(sums, weights, max_repeat), "mix-targets")
    per = sums.groupBy("source", bucket(F.col("__v_fine")).alias("__v_bucket")).agg(F.sum("size").alias("__v_sum"))
    before = Window.partitionBy("source").orderBy("__v_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.withColumn("__v_start", F.coalesce(F.sum("__v_sum").over(before), F.lit(0))).drop("__v_sum")
    starts = starts.withColumnRenamed("source", "__v_source").withColumnRenamed("__v_bucket", "__v_b")
    info = targets.withColumnRenamed("source", "__v_source2")
    starts = materialize(starts.join(info, F.col("__v_source").eqNullSafe(F.col("__v_source2"))).drop("__v_source2"), "mix-starts")

    rows = sized.withColumn("__v_bucket", bucket(fine))
    within = Window.partitionBy("source", "__v_bucket").orderBy("__v_order", F.col("size").desc(), "__v_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__v_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("__v_source")) & (F.col("__v_bucket") == F.col("__v_b")))
    at = F.col("__v_start") + F.col("__v_in")
    goal = F.round("target").cast("long")
    start = F.element_at(F.array(*[F.lit(x) for x in RAMP]), (F.col("source_rank") % len(RAMP) + 1).cast("int"))
    epochs = F.sequence(F.lit(0), F.lit(max_repeat - 1))

    def use(epoch: Column) -> Column:
        first = epoch * F.col("source_size") + at
        words = F.least(F.col("size"), F.greatest(goal - first, F.lit(0)))
        where = position(first.cast("double") + words / 2, F.col("target"), start)
        return F.struct(epoch.cast("int").alias("epoch"), words.cast("long").alias("words"), where.alias("position"))

    uses = F.filter(F.transform(epochs, use), lambda u: u["words"] > 0)
    out = joined.withColumn("uses", uses)
    out = out.withColumn("taken", F.aggregate("uses", F.lit(0).cast("long"), lambda n, u: n + u["words"]))
    out = out.withColumn("position", F.try_element_at(F.transform("uses", lambda u: u["position"]), F.lit(1)))
    return out.select(*base.columns, "size", "source_size", "target", "taken", "uses", "position")


def schedule(mixed: DataFrame) -> DataFrame:
    """One row for each use of a document, range-sorted by training position."""
    keep = [c for c in mixed.columns if c not in ("uses", "position")]
    used = mixed.select(*keep, F.explode("uses").alias("use"))
    return used.select(*keep, "use.epoch", "use.words", "use.position").orderBy("position", "doc_id", "epoch")


def first_words(text: Column, words: Column, size: Column) -> Column:
    """``text`` up to the end of its first ``words`` words of ``size``; whole where the two are equal."""
    runs = F.split(text, f"(?<=[{ASCII_SPACE}])(?=[^{ASCII_SPACE}])")
    lead = F.when(F.btrim(F.element_at(runs, 1), F.lit(ASCII_SPACE)) == "", 1).otherwise(0)
    part = F.array_join(F.slice(runs, F.lit(1), (words + lead).cast("int")), "")
    return F.when(words >= size, text).otherwise(part)
