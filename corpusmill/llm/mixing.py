"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Every source has a weight, from which its target (words to train on) follows, and a weight schedule
over training time 0..1. The schedule's integral gives the share of a source's target that is due by
a time; its inverse assigns each document copy the time at which the source's cumulative words reach
it. Copies sorted by that position are the training order.

A source's documents are dealt to buckets of a hash order. Sums per bucket give each bucket's offset
in the source, and places are found inside a bucket, so a source holding most rows is spread over
many tasks. Rows equal in source, id and size are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.words import packed
from corpusmill.runtime import lookup_join, stored

# Weights of sources in code-point order, null last, repeated.
WEIGHTS = (3.0, 1.0, 2.0)
# Schedules as (time, rate) knots, repeated in the same way: falling, flat, rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
BUCKET_ROWS = 1000


def word_count(c: Column | str) -> Column:
    """Number of runs of characters other than space and the ASCII controls 9 to 13; null is 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5,
                   repeats: float = 2.0) -> DataFrame:
    """Targets of sources, one row each: ``source, size, place, target``.

    ``sizes`` has ``source, size``, one row per source. The sources share ``budget`` times all sizes by
    weight; no target exceeds ``repeats`` times its source's size, and what is above goes to the others
    by weight until none is above. That end point is min(cap, level * weight) for the level at which
    the targets use up the budget; sources sorted by cap per weight give it from running sums.
    The windows run over one row per source, not over documents.
    """
    everything = Window.partitionBy()
    by_place = Window.orderBy(F.col("source").asc_nulls_last())
    known = F.array(*[F.lit(w) for w in weights])
    placed = (sizes.withColumn("place", F.row_number().over(by_place) - 1)
              .withColumn("weight", F.element_at(known, (F.col("place") % len(weights) + 1).cast("int")))
              .withColumn("cap", repeats * F.col("size").cast("double")))
    ratio = F.col("cap") / F.col("weight")
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("ratio", "place").rowsBetween(0, Window.unboundedFollowing)
    levels = (placed.withColumn("ratio", ratio)
              .withColumn("total", budget * F.sum("size").over(everything).cast("double"))
              .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                          / F.sum("weight").over(onward)))
    # the first source in this order that stays below its cap sets the level for all
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)
    return levels.select("source", "size", "place",
                         F.least("cap", F.coalesce(level["level"] * F.col("weight"), F.col("cap"))).alias("target"))


def stretches(knots: tuple[tuple[float, float], ...]) -> Column:
    """A schedule of (time, rate) knots as linear stretches with the share of demand due at their ends."""
    pairs = list(zip(knots, knots[1:]))
    whole = sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in pairs)
    if whole <= 0 or any(b[0] <= a[0] or a[1] < 0 or b[1] < 0 for a, b in pairs):
        raise ValueError("knots need rising times, rates of 0 or more and some demand")
    out, begin = [], 0.0
    for i, (a, b) in enumerate(pairs):
        end = begin + (a[1] + b[1]) / 2 * (b[0] - a[0]) / whole
        fields = {"at": a[0], "rate": a[1] / whole, "slope": (b[1] - a[1]) / (b[0] - a[0]) / whole, "begin": begin,
                  "end": float("inf") if i == len(pairs) - 1 else end}
        out.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in fields.items()]))
        begin = end
    return F.array(*out)


def position(due: Column, schedule: Column) -> Column:
    """Time at which the share ``due`` of a target is reached under the stretches of a schedule.

    The rate is linear on a stretch, so the cumulative demand is quadratic there and is inverted in
    closed form.
    """

    def inside(s: Column) -> Column:
        left = due - s["begin"]
        root = F.sqrt(F.greatest(s["rate"] * s["rate"] + 2 * s["slope"] * left, F.lit(0.0)))
        return s["at"] + F.when(s["slope"] == 0, left / s["rate"]).otherwise((root - s["rate"]) / s["slope"])

    return F.get(F.transform(F.filter(schedule, lambda s: due <= s["end"]), inside), F.lit(0))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, schedules=SCHEDULES, budget: float = 1.5,
                repeats: float = 2.0, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What a mix takes of each document: one row per document.

    Returns ``doc_id, source, size, source_size, target, taken, positions``. ``taken`` are the words the
    mix takes of the document, repeats counted: whole passes over the source in a fixed hash order,
    and in the last pass the documents before the target, of which the last may be taken in part, so a
    source's words sum to its target to the word. ``positions`` holds the training time of each copy,
    the time at which the source's demand reaches the copy's first word; ``training_order`` sorts by it.

    A null text has no words; sources are compared as they are and null is a source of its own, placed
    last. Rows equal in source, id and size share what they take evenly. A null id is an id of its
    own. An empty table gives no rows. Other columns are not read. Reruns agree.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        word_count(text_col).alias("size"))
    groups = stored(sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    totals = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size"),
                                          F.count(F.lit(1)).alias("groups"))
    tasks = F.greatest(F.ceil(F.col("groups") / bucket_rows), F.lit(1))
    targets = source_targets(totals.drop("groups"), weights, budget, repeats)
    targets = stored(targets.join(totals.select("source", tasks.alias("buckets")),
                                  targets["source"].eqNullSafe(totals["source"]))
                     .select(targets["source"].alias("_source"), "place", "target", "buckets",
                             F.col("size").alias("source_size")), "mix-targets")

    # null-safe key for the joins below: the source's place
    known = targets.withColumn("_key", _key("_source")).select("_key", "place", "target", "buckets", "source_size")
    # a fixed hash order, cut into equal stretches, so buckets of a source follow each other
    order = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("size").cast("string")))
    stretch = F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / float(1 << 32)
    dealt = (lookup_join(groups.withColumn("_key", _key("source")), known, ["_key"], spread=["doc_id"])
             .withColumn("_order", order)
             .withColumn("_bucket", F.floor(stretch * F.col("buckets")))
             .withColumn("_words", F.col("size") * F.col("rows")))
    bucket = ["place", "_bucket"]
    sums = dealt.groupBy(*bucket).agg(F.sum("_words").alias("_sum"))
    earlier = Window.partitionBy("place").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*bucket, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = (Window.partitionBy(*bucket).orderBy("_order", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (dealt.withColumn("_before", F.coalesce(F.sum("_words").over(inside), F.lit(0)))
              .join(offsets, bucket)
              .withColumn("_before", F.col("_before") + F.col("_offset")))

    # Words of pass p lie at before + p * source_size; those below the target are taken.
    shown = F.array(*map(stretches, schedules))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("_goal") / F.col("source_size"))).otherwise(0)
    part = F.least(F.col("_words"), F.col("_goal") - F.col("_passes") * F.col("source_size") - F.col("_before"))
    copies = F.col("_passes") + F.when(F.col("_part") > 0, 1).otherwise(0)
    times = F.when((F.col("_words") > 0) & (copies > 0), F.transform(
        F.sequence(F.lit(0).cast("long"), copies - 1),
        lambda p: position((F.col("_before") + p * F.col("source_size")) / F.col("target"), F.col("_schedule"))))
    taken = (placed.withColumn("_goal", F.round("target").cast("long"))
             .withColumn("_passes", F.least(passes, F.lit(int(repeats))).cast("long"))
             .withColumn("_part", F.greatest(F.lit(0), part))
             .withColumn("_taken", (F.col("_passes") * F.col("_words") + F.col("_part")).cast("long"))
             .withColumn("_schedule", F.element_at(shown, (F.col("place") % len(schedules) + 1).cast("int")))
             .withColumn("positions", F.coalesce(times, F.array().cast("array<double>"))))
    n = F.col("rows")
    over = F.col("_taken") % n
    share = (F.col("_taken") - over) / n + F.when(F.col("_i") < over, 1).otherwise(0)
    return (taken.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
            .select("doc_id", "source", "size", "source_size", "target", share.cast("long").alias("taken"),
                    "positions"))


def _key(source: str) -> Column:
    """A source as a join key that also holds for null."""
    return F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows range-sorted by ``position``, equal ones by id and source; rows without a position come last."""
    order = [F.col(c).asc_nulls_last() for c in ("position", "doc_id", "source")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(taken: DataFrame) -> DataFrame:
    """One row per copy in training order: range-sorted by ``position``, equal ones by id and source."""
    return in_order(taken.withColumn("position", F.explode("positions")).drop("positions"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """The documents of the mix in training order: whole copies, each as often as the mix takes it, to the nearest.

    All columns of ``docs`` are kept. A copy taken in part counts if at least half of it is taken; a
    document without words costs nothing and is kept once, at a time given by a hash of its id.
    Partitions, and files written from them, follow each other in the order of the copies' times.
    """
    taken = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    copies = (F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5))
              .cast("int"))
    counted = (taken.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                             F.col("size").alias("_size"))
               .agg(F.max(copies).alias("_copies"), F.max("positions").alias("_positions"))  # equal in a group
               .filter(F.col("_copies") > 0))
    rows = packed(docs, id=F.col(id_col), source=F.col(source_col), words=word_count(text_col))
    joined = rows.join(counted, rows["id"].eqNullSafe(counted["_id"]) & (rows["words"] == counted["_size"])
                       & rows["source"].eqNullSafe(counted["_source"]))
    anywhere = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 20)) / float(1 << 20)
    times = F.when(F.col("words") == 0, F.array(anywhere)).otherwise(F.slice("_positions", F.lit(1), F.col("_copies")))
    copies = joined.select("doc", F.col("id").alias("doc_id"), "source", times.alias("positions"))
    return training_order(copies).select("doc.*")
