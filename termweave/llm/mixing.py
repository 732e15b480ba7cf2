"""Mixing sources to target weights on a time-varying curriculum.

Each source has a weight schedule over training time 0 .. 1. Integrated and scaled to the source's target, the schedule
is its cumulative demand for words; inverted at the words that a document and those before it supply, it gives the
document's training position. Documents are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import written

#: Base weights, dealt to the sources in order and repeated.
WEIGHTS = (5, 2, 1)
#: Slope of each weight's schedule w(t) = 1 + slope * (2t - 1): the first falls, the last rises.
SLOPES = (-0.5, 0.0, 0.5)
#: Documents of a source that one window task orders, about.
BUCKET_ROWS = 20_000
#: Columns that ``mix`` adds or uses on its way.
ADDED = ("size", "source_size", "target", "copies", "taken", "position", "slope", "_share", "pass_length", "_order", "_bucket", "_null", "_source", "_before", "_inside")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, cap: int = 2) -> DataFrame:
    """source, source_size, weight, slope, target for the table ``sizes`` (source, source_size), a row for each source.

    All targets sum to ``share_percent`` of all sizes; where weight's share passes ``cap`` times the source's size, the
    target stops there and the excess is shared again by weight. That ends in a water level: ``least(cap * size,
    level * weight)``, found from running sums over the sources by cap / weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    n = F.pmod(rank, F.lit(len(weights)))

    def pick(values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))

    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = (
        sizes.withColumn("weight", pick(weights).cast("long"))
        .withColumn("slope", pick([SLOPES[i % len(SLOPES)] for i in range(len(weights))]).cast("double"))
        .withColumn("cap", F.col("source_size") * cap)
        .withColumn("budget", F.sum("source_size").over(everything) * share_percent)  # in hundredths
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("free", F.col("budget") - 100 * (F.sum("cap").over(upto) - F.col("cap")))
        .withColumn("open", F.col("weights") - (F.sum("weight").over(upto) - F.col("weight")))
        # the first source, by cap / weight, that its share doesn't fill, sets the level
        .withColumn("below", F.col("free") * F.col("weight") < 100 * F.col("cap") * F.col("open"))
        .withColumn("level_free", F.first(F.when(F.col("below"), F.col("free")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("level_open", F.first(F.when(F.col("below"), F.col("open")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    level = F.col("weight") * F.col("level_free") / (F.col("level_open") * F.lit(100.0))
    target = F.when(F.col("level_free").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level))
    return levels.select("source", "source_size", "weight", "slope", target.alias("target"))


def position(share: Column, slope: Column) -> Column:
    """The time at which a source with this slope has met the ``share`` (0 .. 1) of its demand.

    The schedule 1 + slope * (2t - 1) integrates to D(t) = (1 - slope) t + slope t**2; this inverts it.
    """
    b = 1 - slope
    root = (-b + F.sqrt(b * b + 4 * slope * share)) / (2 * slope)
    return F.when(slope == 0, share).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), root)))


def mix(docs: DataFrame, size: Column | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every row of ``docs`` (columns doc_id, source; ``size`` counts its words) with copies, taken, position, target.

    A source's documents are ordered by the MD5 of doc_id, doc_id, size and, where the text is there, a hash of it. Whole passes over the source come
    first; of the pass that remains, a document is taken while the words up to its middle lie below what is missing. So
    a source's taken words differ from its target by half a document at most, and no document is taken more than
    ``cap`` times. Null doc_ids and texts count as rows of size 0 or of their words; a source may be null; rows with
    size 0 are taken as often as their place says. An empty table gives no rows. Added columns: size, source_size,
    target, copies (int), taken, position (time of the first copy, null if none), slope, _share and pass_length; they, and
    the operator's own helpers (``ADDED``), replace columns of the input with these names.

    Running sums go over buckets of the order first and inside each bucket then: no window holds a whole source.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") if size is None else size
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(*[c for c in docs.columns if c.lower() not in ADDED], size.alias("size"), order.alias("_order"))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    most = sums.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("n")).first()["n"]
    digits = 1
    while most > bucket_rows * 16**digits and digits < 8:
        digits += 1
    rows = rows.withColumn("_bucket", F.substring("_order", 1, digits))
    key = F.col("source").isNull(), F.coalesce(F.col("source"), F.lit(""))
    rows = rows.withColumn("_null", key[0]).withColumn("_source", key[1])
    buckets = rows.groupBy("_null", "_source", "_bucket").agg(F.sum("size").alias("of_bucket"))
    before = buckets.withColumn("_before", F.sum("of_bucket").over(Window.partitionBy("_null", "_source").orderBy("_bucket")) - F.col("of_bucket")).drop("of_bucket")
    targets = source_targets(sums.select("source", "source_size")).select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "slope", "target")
    within = Window.partitionBy("_null", "_source", "_bucket").orderBy("_order", F.col("doc_id").asc_nulls_first(), "size", *([F.xxhash64("text")] if "text" in rows.columns else [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_inside", F.sum("size").over(within) - F.col("size")).join(before.join(targets, ["_null", "_source"]), ["_null", "_source", "_bucket"])
    start = F.col("_before") + F.col("_inside")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    missing = F.col("target") - whole * F.col("source_size")
    extra = (2 * start + F.col("size")).cast("double") < 2 * missing
    copies = (whole + F.when(extra, 1).otherwise(0)).cast("int")
    share = F.least(F.lit(1.0), F.when(F.col("target") > 0, start / F.col("target")).otherwise(F.lit(0.0)))
    pass_length = F.when(F.col("target") > 0, F.col("source_size") / F.col("target")).otherwise(F.lit(0.0))
    return (
        placed.withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .withColumn("_share", share)
        .withColumn("pass_length", pass_length)
        .withColumn("position", F.when(F.col("copies") > 0, position(F.col("_share"), F.col("slope"))))
        .drop("_order", "_bucket", "_null", "_source", "_before", "_inside")
    )


def in_training_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each copy that the mix takes, with ``columns`` and position, range-sorted by position."""
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_copy")
    copies = mixed.where("copies > 0").select(*columns, "slope", "_share", "pass_length", copy)
    share = F.least(F.lit(1.0), F.col("_share") + F.col("_copy") * F.col("pass_length"))
    return copies.select(*columns, position(share, F.col("slope")).alias("position")).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def training_order(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id, text, source) without texts, and its copies in training order, both written.

    Both have _row, which names a row of the mix: doc_ids may be null or repeat.
    """
    mixed = mix(docs.select("doc_id", "text", "source")).drop("text").withColumn("_row", F.monotonically_increasing_id())
    mixed = written(mixed, "mixed")
    return mixed, written(in_training_order(mixed, ["_row", "doc_id", "source"]), "training-order")


def taken_words(mixed: DataFrame, ordered: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``mixed``: the words of its copies in ``ordered``."""
    copies = ordered.groupBy("_row").agg(F.count("position").alias("_copies"))
    taken = F.coalesce(F.col("_copies"), F.lit(0)) * F.col("size")
    return mixed.join(copies, "_row", "left").select("doc_id", "size", "source_size", "target", taken.alias("taken"))
