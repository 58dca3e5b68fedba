"""Events and evidence: severity, tone, reliability, signals, promotion, governance of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that decide how grave an event is, and what a source is.
GRAVE = "处罚|调查|重大|负面|诉讼|仲裁|无效|泄露"
TONES = (("处罚|调查", "critical"), ("延期|诉讼|仲裁", "high"), ("结项", "low"))
RELIABILITY = (("上交所|交易所", "exchange"), ("年报|定期报告|招股", "filing"), ("政府|监管|官方|联邦公报|清单", "official"))
HEAT = {"high": 90, "medium": 65, "watch": 40}
VERIFIED = 0.85
VENDORS = ("Wind", "同花顺", "天眼查", "企查查", "智慧芽", "PatSnap", "incoPat", "IT桔子", "IT 桔子", "烯牛", "慧博")
EXCHANGE_HOST = "sse.com.cn"


def _first(c: Column, table: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    out = F.when(c.rlike(table[0][0]), table[0][1])
    for pattern, value in table[1:]:
        out = out.when(c.rlike(pattern), value)
    return out.otherwise(otherwise)


def severity(kind: Column, event_type: Column, title: Column) -> Column:
    """high for list hits and grave words, medium for inquiries and litigation, else watch."""
    grave = F.concat(F.coalesce(event_type, F.lit("")), F.coalesce(title, F.lit(""))).rlike(GRAVE)
    return F.when((kind == "screening") | grave, "high").when(kind.isin("inquiry", "litigation"), "medium").otherwise("watch")


def event_tone(event_type: Column) -> Column:
    """Tone of an event found by a deep search."""
    return _first(F.coalesce(event_type, F.lit("")), TONES, "medium")


def reliability(source_type: Column, institution: Column) -> Column:
    return _first(F.concat_ws(" ", source_type, institution), RELIABILITY, "media")


def category(kind: Column, indicator_id: Column) -> Column:
    """Category of the signal that an event makes."""
    return (
        F.when(kind.isin("screening", "litigation"), "监管政策").when(kind == "inquiry", "资本市场").when(indicator_id == "R09", "技术论文/专利").otherwise("企业披露")
    )


def heat(severity_: Column) -> Column:
    out = F.when(severity_ == "high", HEAT["high"]).when(severity_ == "medium", HEAT["medium"])
    return out.otherwise(HEAT["watch"])


def verification(confidence: Column) -> Column:
    return F.when(confidence >= VERIFIED, "verified").otherwise("monitoring")


def signals(events: DataFrame) -> DataFrame:
    """A signal for each event: id, company_id, category, severity, heat, reliability, verification and the texts a reader needs.

    events: event_id, company_id, kind, event_type, title, notes, indicator_id, event_date, url, confidence.
    """
    grade = severity(F.col("kind"), F.col("event_type"), F.col("title"))
    notes = F.nullif(F.col("notes"), F.lit(""))
    source = F.when(F.contains("url", F.lit(EXCHANGE_HOST)), "exchange").when(F.col("kind") == "screening", "official").otherwise("media")
    return events.select(
        F.concat(F.lit("signal:"), F.col("event_id").cast("string")).alias("signal_id"), "event_id", "company_id",
        category(F.col("kind"), F.col("indicator_id")).alias("category"), grade.alias("severity"), "title", F.coalesce(notes, "event_type").alias("summary"),
        F.array(F.col("event_type"), F.coalesce(notes, F.lit("等待后续披露复核"))).alias("key_facts"), "indicator_id", heat(grade).alias("heat"), "event_date",
        "url", source.alias("reliability"), verification(F.col("confidence")).alias("verification"),
    )


def brief(signals_: DataFrame, most: int = 10) -> DataFrame:
    """One row: the newest grave signals (at most `most`, a feature of the brief), signals not yet verified, companies with grave ones."""
    high = F.col("severity") == "high"
    first = signals_.where(high).orderBy(F.col("event_date").desc(), "event_id").limit(most)
    first = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_date(F.col("event_date").cast("date"))).alias("d"), "event_id", "signal_id"))), lambda x: x["signal_id"]), ",").alias("priority_signals"))
    counts = signals_.agg(F.count("*").alias("signals"), F.count_if(F.col("verification") != "verified").alias("pending"), F.count_distinct(F.when(high, F.col("company_id"))).alias("high_companies"))
    return counts.withColumn("_one", F.lit(1)).join(first.withColumn("_one", F.lit(1)), "_one").drop("_one")


def promoted(register: DataFrame, signals_: DataFrame) -> DataFrame:
    """The event register with signals as events; one that the register has, by company and signal, is not added again."""
    new = signals_.dropDuplicates(["company_id", "signal_id"]).join(register.select("company_id", "signal_id"), ["company_id", "signal_id"], "left_anti")
    added = new.select("company_id", "signal_id", "title", "severity", F.lit("open").alias("status"), "event_date")
    return register.unionByName(added)


def candidate_source(name: Column) -> Column:
    """Whether a source is one of the vendors whose use is not licensed yet."""
    return F.coalesce(name.rlike("|".join(VENDORS)), F.lit(False))


def effective(name: Column, strength: Column, basis: Column) -> Column:
    """Whether evidence counts: no candidate vendor's, and direct, or inferred on a stated basis."""
    stated = F.length(F.trim(F.coalesce(basis, F.lit("")))) > 0
    return ~candidate_source(name) & F.coalesce((strength == "direct") | ((strength == "inferred") & stated), F.lit(False))


def registry(evidence: DataFrame, governance: DataFrame) -> DataFrame:
    """Evidence that a governance record covers, with what that says; the rest may not support a score."""
    return evidence.join(governance, ["evidence_id", "company_id"])


def referenced(references: DataFrame, registry_: DataFrame) -> DataFrame:
    """References that name evidence of the registry by id, company and strength."""
    return references.join(registry_, ["evidence_id", "company_id", "strength"], "left_semi")


def by_url(signals_: DataFrame, evidence: DataFrame) -> DataFrame:
    """signal_id, evidence_id of the same address."""
    return signals_.select("signal_id", "url").join(evidence.select("evidence_id", "url"), "url").select("signal_id", "evidence_id")


def overlapping(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node of each event that shares most evidence ids with it, the first of equals; without any shared, the first node of its company.

    events: event_id, company_id, evidence_ids; nodes: node_id, company_id, position, evidence_ids.
    """
    shared = (
        events.select("event_id", F.explode(F.array_distinct("evidence_ids")).alias("e"))
        .join(nodes.select("node_id", "position", F.explode(F.array_distinct("evidence_ids")).alias("e")), "e")
        .groupBy("event_id", "node_id", "position").agg(F.count("*").alias("n"))
    )
    best = shared.groupBy("event_id").agg(F.max_by(F.struct("node_id", "n"), F.struct("n", -F.col("position"))).alias("b"))
    first = nodes.groupBy("company_id").agg(F.min_by("node_id", "position").alias("first"))
    joined = events.join(best, "event_id", "left").join(first, "company_id", "left")
    return joined.select("event_id", F.coalesce("b.node_id", "first").alias("node_id"), F.coalesce("b.n", F.lit(0)).alias("shared"))
