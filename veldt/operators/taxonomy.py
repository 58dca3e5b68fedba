"""Classifiers: redistribution of sources, dimensions by their aliases, legacy indicators and their admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.text import text_or_empty

#: Names that tell a vendor's data and a user's own (fixed values).
VENDOR, OWN = "天眼查", "用户提供"

# The dimensions' labels, and all names by which sources call them.
LABELS = {"narrative": "叙事风险", "technology": "技术风险", "compliance": "合规风险", "finance": "财务与融资风险", "external": "外部风险", "personnel": "人员风险"}
ALIASES = {
    "narrative": ["narrative", "叙事", "叙事风险"],
    "technology": ["technology", "tech", "cyber", "ip", "技术", "技术风险", "技术与算法", "网络安全", "知识产权"],
    "compliance": ["compliance", "data", "ethics", "regulatory", "合规", "合规风险", "数据合规", "科技伦理", "监管政策", "安全合规", "诉讼仲裁", "知识产权许可合规", "知识产权诉讼", "开源许可合规"],
    "finance": ["finance", "财务风险", "融资风险", "经营财务", "财务与融资风险"],
    "external": ["external", "外部风险", "外部环境", "外部环境/地缘", "地缘政治风险", "供应链风险"],
    "personnel": ["personnel", "人员风险", "人才风险"],
}
#: Label of a missing name (fixed value).
UNCLASSIFIED = "未分类风险"


def redistribution(source_type: Column, institution: Column) -> Column:
    """licensed-derived where the vendor is named, else manual for a user's own, else public-link-only."""
    kind, house = text_or_empty(source_type), text_or_empty(institution)
    return F.when(kind.contains(VENDOR) | house.contains(VENDOR), "licensed-derived").when(kind.contains(OWN), "manual").otherwise("public-link-only")


def _lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), key)


def dimension_id(name: Column) -> Column:
    """The dimension that a name stands for, blanks around it ignored; null for a name unknown."""
    return _lookup([(alias, d) for d, found in ALIASES.items() for alias in found], F.trim(name))


def dimension_label(name: Column) -> Column:
    """The dimension's label, else the name itself, trimmed."""
    return F.coalesce(_lookup(list(LABELS.items()), dimension_id(name)), F.trim(name), F.lit(UNCLASSIFIED))


def dimension_ids(names: Column) -> Column:
    """The dimensions of an array of names, each once, in the order of their first name."""
    return F.array_distinct(F.array_compact(F.transform(names, dimension_id)))


def dimension_labels(names: Column) -> Column:
    return F.transform(dimension_ids(names), lambda d: _lookup(list(LABELS.items()), d))


def remapped_indicators(mentions: DataFrame, indicators: DataFrame, legacy: DataFrame) -> DataFrame:
    """Indicators that entities mention, each once, by their present id: a known id is kept, else mapped, else dropped.

    mentions: entity, position, indicator_id; it is counted by entity and id as written before anything else, so that repeated
    mentions cross no shuffle twice. indicators: indicator_id, admission_status; legacy: legacy_id, indicator_id, one row an id.
    Both are configuration, bounded by the catalogue of indicators. Adds first_position, mentions, admission_status.
    """
    counted = mentions.groupBy("entity", "indicator_id").agg(F.min("position").alias("position"), F.count("*").alias("mentions"))
    known = F.broadcast(indicators.select("indicator_id", F.lit(True).alias("known")))
    mapped = F.broadcast(legacy.select(F.col("legacy_id").alias("indicator_id"), F.col("indicator_id").alias("now")))
    present = F.when(F.col("known"), F.col("indicator_id")).otherwise(F.col("now"))
    kept = counted.join(known, "indicator_id", "left").join(mapped, "indicator_id", "left").select("entity", present.alias("indicator_id"), "position", "mentions")
    once = kept.where("indicator_id is not null").groupBy("entity", "indicator_id").agg(F.min("position").alias("first_position"), F.sum("mentions").alias("mentions"))
    return once.join(F.broadcast(indicators), "indicator_id", "left").select("entity", "indicator_id", "first_position", "mentions", "admission_status")


def customer_visible(remapped: DataFrame) -> DataFrame:
    """Indicators of the catalogue that are no candidates, numbered within an entity in the order of their first mention."""
    order = Window.partitionBy("entity").orderBy("first_position", "indicator_id")
    return remapped.where("admission_status <> 'candidate'").withColumn("ordinal", F.row_number().over(order))


def admitted(remapped: DataFrame) -> DataFrame:
    return remapped.where("admission_status = 'validated'")


def observed(remapped: DataFrame) -> DataFrame:
    return remapped.where("admission_status = 'observation'")
