"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]; its integral is the share of the
words that the mixture takes of the source by t. What is taken of a document is decided by one hash
order of its source, when it is read by another, independent one: a copy of a document whose taken
words begin at a fraction u of all that are taken of its source is read at the time t at which the
integral reaches u. So positions come from inverting the cumulative demand, and the mixture is the
copies range-sorted by position. Copies follow each other by whole rounds over the source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import checkpointed, word_count

#: A source's words are repeated at most this often.
MOST_REPEATS = 3
#: Weights by the place of a source in code-point order, repeating.
WEIGHT_CYCLE = (5, 2, 1)
#: Slopes of the sources' schedules, by the place of a source over the length of the cycle, repeating.
SLOPES = (0.0, 0.5, -0.5)


def source_targets(sizes: DataFrame, cycle=WEIGHT_CYCLE, cap: float = MOST_REPEATS) -> DataFrame:
    """One row per source: source, place, source_size, weight, target.

    `sizes` has source and size. Targets are weight * level, at most cap * source_size, with the
    level at which they add up to all words: what capped sources leave is shared again by weight
    until none is above its cap. Sources with the least cap/weight are capped first, which one
    ordered pass over the sources finds. There is one row per source here, never per document.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(float(w)) for w in cycle))
    ranked = by.withColumn("_place", F.row_number().over(order) - 1).withColumn(
        "weight", F.get(weights, F.col("_place") % len(cycle))
    )
    ranked = ranked.withColumn("_limit", cap * F.col("source_size").cast("double"))
    ranked = ranked.withColumn("_ratio", F.col("_limit") / F.col("weight"))
    up = Window.orderBy("_ratio", "_place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("_total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("_capped", F.coalesce(F.sum("_limit").over(up), F.lit(0.0)))
        .withColumn("_weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_weight_left"))
        .withColumn("_free", F.col("_level") <= F.col("_ratio"))
    )
    # the level is that of the first source, in this order, that stays under its cap
    level = F.min(F.when(F.col("_free"), F.struct("_ratio", "_place", "_level"))).over(whole)
    return ranked.withColumn("_found", level).select(
        "source",
        F.col("_place").alias("place"),
        "source_size",
        "weight",
        F.least(F.col("_limit"), F.coalesce(F.col("weight") * F.col("_found._level"), F.col("_limit"))).alias("target"),
    )


def _digest(salt: str, *parts: str) -> F.Column:
    """MD5 of a salt and some columns, as hex digits: an order that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(salt), *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)).cast("binary"))


def _bucketed(df: DataFrame, digits: int) -> DataFrame:
    """Add the orders of choice and of reading within a bucket, and the bucket: the first digits of the former."""
    out = df.withColumn("_choice", _digest("choose", "doc_id", "size")).withColumn("_reading", _digest("read", "doc_id", "size"))
    return out.withColumn("_bucket", F.substring("_choice", 1, digits))


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: written once, so that no text is split again for the targets."""
    return checkpointed(docs.select("doc_id", "source", word_count("text").alias("size")))


def _buckets(slim: DataFrame, targets: DataFrame, digits: int) -> DataFrame:
    """One row per source and bucket: what earlier buckets hold in both orders, and the source's numbers.

    Buckets are chosen in the order of their names and read in the order of a hash of their names, so
    what is chosen says nothing about when it is read. There are 16 ** digits of them a source.
    """
    sums = _bucketed(slim, digits).groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = _with_targets(sums, targets)
    ahead = (Window.unboundedPreceding, -1)
    chosen = Window.partitionBy("source").orderBy("_bucket").rowsBetween(*ahead)
    read = Window.partitionBy("source").orderBy("_when", "_bucket").rowsBetween(*ahead)
    words = F.floor(F.col("target") + 0.5).cast("long")
    sums = sums.withColumn("_words", words).withColumn("_whole", F.floor(words / F.greatest("source_size", F.lit(1))).cast("long"))
    sums = sums.withColumn("_rest", F.col("_words") - F.col("_whole") * F.col("source_size"))
    sums = sums.withColumn("_ahead_chosen", F.coalesce(F.sum("_sum").over(chosen), F.lit(0))).withColumn("_when", _digest("bucket", "_bucket"))
    extra = F.least(F.greatest(F.col("_rest") - F.col("_ahead_chosen"), F.lit(0)), F.col("_sum"))
    sums = sums.withColumn("_ahead_read", F.coalesce(F.sum("_sum").over(read), F.lit(0)))
    return sums.withColumn("_ahead_extra", F.coalesce(F.sum(extra).over(read), F.lit(0))).drop("_sum", "_when", "weight")


def _time(u: F.Column, slope: F.Column) -> F.Column:
    """The t at which (1 - slope) t + slope t**2, the integral of 1 + slope * (2t - 1), is u."""
    root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope)
    return F.when(F.abs(slope) < 1e-12, u).otherwise(root)


def _planned(sized: DataFrame, slim: DataFrame, cycle, cap: float, slopes: tuple[float, ...]) -> DataFrame:
    """sized, which has doc_id, source and size, with source_size, target, taken and positions.

    Rows are moved once, to their source's bucket, so that no window holds a whole source.
    """
    digits = max(3, math.ceil(math.log2(max(slim.count(), 1)) / 8))
    buckets = _buckets(slim, source_targets(slim, cycle, cap), digits)
    keys = [F.coalesce(F.col("source"), F.lit("")).alias("_source"), F.col("source").isNull().alias("_no_source")]
    named = buckets.select("*", *keys).drop("source")
    joined = _bucketed(sized, digits).select("*", *keys).join(named, ["_source", "_no_source", "_bucket"])
    own = Window.partitionBy("_source", "_no_source", "_bucket")
    ahead = (Window.unboundedPreceding, -1)
    chosen = own.orderBy("_choice", "doc_id", "size").rowsBetween(*ahead)
    read = own.orderBy("_reading", "doc_id", "size").rowsBetween(*ahead)

    def before(base: str, value: str, order) -> F.Column:
        return F.col(base) + F.coalesce(F.sum(value).over(order), F.lit(0))

    out = joined.withColumn("_at", before("_ahead_chosen", "size", chosen))
    out = out.withColumn("_extra", F.least(F.greatest(F.col("_rest") - F.col("_at"), F.lit(0)), F.col("size")))
    out = out.withColumn("_round", before("_ahead_read", "size", read)).withColumn("_last", before("_ahead_extra", "_extra", read))
    out = out.withColumn("taken", (F.col("_whole") * F.col("size") + F.col("_extra")).cast("long"))
    slope = F.get(F.array(*(F.lit(float(x)) for x in slopes)), F.floor(F.col("place") / len(cycle)).cast("long") % len(slopes))
    total = F.greatest("_words", F.lit(1)).cast("double")
    out = out.withColumn("_slope", slope)
    rounds = F.when(F.col("_whole") > 0, F.sequence(F.lit(0), F.col("_whole").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    whole = F.transform(rounds, lambda i: _time((i * F.col("source_size") + F.col("_round")) / total, F.col("_slope")))
    last = _time((F.col("_whole") * F.col("source_size") + F.col("_last")) / total, F.col("_slope"))
    positions = F.concat(whole, F.when(F.col("_extra") > 0, F.array(last)).otherwise(F.array().cast("array<double>")))
    out = out.withColumn("positions", F.when(F.col("taken") > 0, positions).otherwise(F.array().cast("array<double>")))
    return out.drop(*[c for c in out.columns if c.startswith("_")], "place")


def _with_targets(rows: DataFrame, targets: DataFrame, bound: int = 20_000) -> DataFrame:
    """Join by source, nulls equal. The targets are broadcast only if they are at most `bound` rows."""
    few = targets.limit(bound + 1).count() <= bound
    named = targets.withColumnRenamed("source", "_of")
    on = F.col("source").eqNullSafe(F.col("_of"))
    return rows.join(F.broadcast(named) if few else named, on).drop("_of")


def mix(
    docs: DataFrame, cycle=WEIGHT_CYCLE, cap: float = MOST_REPEATS, slopes: tuple[float, ...] = SLOPES
) -> DataFrame:
    """Words taken from every document and where training reads it.

    docs: `doc_id`, `text`, `source`; other columns are ignored. Returns one row per row of docs:
    doc_id, size, source, source_size, target, taken, position (0..1, of its first copy, null if
    nothing is taken), positions (of all its copies, the last of which may be in part), sorted by
    position. Every document is read target/source_size times, rounded down; of the rest, documents
    in a fixed hash order are read once more until the target is met, the last of them in part, so
    that each source's taken words are its target, rounded. At any time t of training, the words
    taken of a source so far are the integral of its schedule, but for the document being read.

    Null or empty texts have size 0 and take 0. A null source is a source, last in order. Rows with
    the same doc_id and size are each a document; ties change which of the equal rows is read more,
    never how much. An empty table gives no rows.
    """
    sizes = _sizes(docs)
    planned = _planned(sizes, sizes, cycle, cap, slopes).withColumn("position", F.get("positions", F.lit(0)))
    kept = ["doc_id", "size", "source", "source_size", "target", "taken", "position", "positions"]
    return planned.select(*kept).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(
    docs: DataFrame, cycle=WEIGHT_CYCLE, cap: float = MOST_REPEATS, slopes: tuple[float, ...] = SLOPES
) -> DataFrame:
    """The mixture itself: each document as often as it is taken, the last copy cut where needed.

    Same columns as docs, sorted by each copy's own position; a cut copy keeps its first words, as
    they stand, and gets n_chars anew if docs has it. Documents of which nothing is taken are left out.
    """
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text", "source") else f"own_{c}") for c in names])
    planned = _planned(inner.withColumn("size", word_count("text")), _sizes(docs), cycle, cap, slopes).where("taken > 0")
    copies = planned.select("*", F.posexplode("positions").alias("copy", "position"))
    left = F.col("taken") - F.col("copy") * F.col("size")
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(left >= F.col("size"), F.col("text")).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.greatest(left.cast("int"), F.lit(1))), "")
    )
    out = copies.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("own_n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    out = out.orderBy("position", "doc_id")
    return out.select(*[F.col(c if c in ("doc_id", "text", "source") else f"own_{c}").alias(c) for c in names])
