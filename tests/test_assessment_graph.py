"""The graph of planted assessments, its views, and requests' canonical text and identifiers."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from veldt.functions import canonical as J
from veldt.operators import assessment_graph as G


@pytest.fixture(scope="module")
def parts(spark):
    make = spark.createDataFrame
    day = datetime.date
    head = make([("c", "Co", 61.5, "high", day(2024, 7, 1)), ("d", "Do", None, None, day(2024, 7, 1))], "company_id string, label string, score double, level string, as_of date")
    dims = make([("c", "technology", "T", 50.0, "high", 1), ("c", "compliance", "C", None, None, 2), ("d", "technology", "T", 1e-7, "low", 1)], "company_id string, dimension_id string, label string, score double, level string, place int")
    ind = make([("c", "T01", "technology", "one", 4, 20.0, "low", 1), ("c", "C01", "compliance", "two", 5, None, None, 2), ("d", "T01", "technology", "one", 4, 3.25, "low", 1)], "company_id string, indicator_id string, dimension_id string, label string, weight int, score double, level string, place int")
    ref = [
        ("c", "C01", "e1", "direct", "p. 1", None, None, None), ("c", "T01", "e1", "inferred", None, "because", day(2024, 7, 1), None), ("c", "T01", "e2", "background", "p. 3", None, None, day(2024, 7, 1)),
        ("c", "C01", "e2", "direct", "p. 4", None, day(2024, 7, 2), None), ("d", "T01", "e1", "direct", "p. 9", None, day(2024, 1, 1), day(2024, 7, 2)),
    ]
    ref = make(ref, "company_id string, indicator_id string, evidence_id string, support string, locator string, inference_basis string, valid_from date, valid_to date")
    cat = make([("c", "e1", "first", "s", 0), ("c", "e2", "second", "s", 1), ("d", "e1", "first", "s", 0)], "company_id string, evidence_id string, title string, source_name string, place int")
    red = make([("c", "v1", "fire", "critical", "P0", ["C01", "T01", "C01", "X9"], ["e2"], 0), ("c", "v2", "theft", "watch", "P1", ["T01"], [], 1)], "company_id string, event_id string, title string, severity string, priority string, indicator_ids array<string>, evidence_ids array<string>, place int")
    paths = make([("c", "p1", "v1", True, "t1"), ("c", "p2", "v1", False, "t2"), ("c", "p3", "other", True, "t3"), ("d", "p4", "v1", True, "t4")], "company_id string, path_id string, event_id string, included boolean, trace string")
    return head, dims, ind, G.in_force(ref, head), cat, red, paths


@pytest.fixture(scope="module")
def graph(parts):
    head, dims, ind, ref, cat, red, paths = parts
    return G.nodes(head, dims, ind, red, ref, cat).cache(), G.edges(dims, ind, ref, red, paths).cache()


def test_relations_are_in_force_from_their_first_day_to_before_their_last(parts):
    assert {(r.company_id, r.indicator_id, r.evidence_id) for r in parts[3].collect()} == {("c", "C01", "e1"), ("c", "T01", "e1"), ("d", "T01", "e1")}


def test_nodes_of_five_kinds(graph):
    got = {(r.company_id, r.id): (r.kind, r.caption, r.tone, r.dimension_ids) for r in graph[0].collect()}
    assert got["c", "company:c"] == ("company", "61.5 分 · 高风险", "high", ["technology", "compliance"])
    assert got["d", "company:d"] == ("company", "— 分 · 数据不足风险", "neutral", ["technology"])
    assert got["d", "dimension:technology"][1] == "1e-7 分 · 低风险" and got["c", "indicator:T01"][1] == "T01 · 20 分"
    assert got["c", "event:v1"] == ("event", "P0 · 独立红旗", "critical", ["compliance", "technology"])  # first seen first, unknown left out
    assert got["c", "event:v2"][2:] == ("medium", ["technology"])
    assert got["c", "evidence:e1"][3] == ["technology", "compliance"]  # in the order of the indicators
    assert got["c", "evidence:e2"][3] == [] and len(got) == 13


def test_edges_and_counts(graph):
    got = {(r.company_id, r.id): (r.source, r.target, r.kind, r.detail) for r in graph[1].collect()}
    assert got["c", "evidence:T01:e1:inferred"] == ("indicator:T01", "evidence:e1", "inferred", "because")
    assert got["c", "evidence:C01:e1:direct"][3] == "p. 1" and got["c", "structure:technology:T01"][3] == "固定权重 4"
    assert got["c", "propagation:p1"] == ("event:v1", "company:c", "propagation", "t1")
    assert not {k for _, k in got if k in ("propagation:p2", "propagation:p3", "propagation:p4")}  # not included, no red flag, another company's
    assert ("c", "event-evidence:v1:e2") in got and ("c", "event-indicator:v1:X9") in got
    counts = {r.company_id: r.asDict() for r in G.counts(*graph).collect()}
    assert counts["c"]["direct_evidence"] == counts["c"]["inferred_evidence"] == counts["c"]["propagation_paths"] == 1 and counts["c"]["nodes"] == 9
    assert counts["d"] == {"company_id": "d", "nodes": 4, "edges": 3, "direct_evidence": 1, "inferred_evidence": 0, "background_evidence": 0, "propagation_paths": 0}


def ids(view):
    return {(r.company_id, r.id) for r in view[0].collect()}, {(r.company_id, r.id) for r in view[1].collect()}


def test_views(graph):
    nodes, edges = ids(G.dimension_view(*graph, "compliance"))
    assert nodes == {("c", "company:c"), ("d", "company:d"), ("c", "dimension:compliance"), ("c", "indicator:C01"), ("c", "event:v1")}
    assert ("c", "event-indicator:v1:C01") in edges and not any("evidence" in e for _, e in edges)
    nodes, edges = ids(G.dimension_view(*graph, "compliance", "indicator:C01"))
    assert ("c", "evidence:e1") in nodes and {e for _, e in edges if e.startswith("evidence")} == {"evidence:C01:e1:direct"}
    assert ids(G.dimension_view(*graph, "compliance", "indicator:T01"))[0] == ids(G.dimension_view(*graph, "compliance"))[0]  # of another dimension
    assert ("c", "evidence:e2") in ids(G.dimension_view(*graph, "compliance", "evidence:e2"))[0]
    nodes, edges = ids(G.overview(*graph))
    assert ("c", "event:v2") in nodes and ("c", "propagation:p1") in edges and not any(i.startswith(("indicator", "evidence")) for _, i in nodes)
    nodes, edges = ids(G.lineage(*graph))
    assert {i for c, i in nodes if c == "c"} == {"company:c", "event:v1", "indicator:T01", "indicator:C01", "dimension:technology", "dimension:compliance", "evidence:e1", "evidence:e2"}
    assert {i for c, i in ids(G.lineage(*graph, "v2"))[0] if c == "c"} == {"company:c", "event:v2", "indicator:T01", "dimension:technology", "evidence:e1"}
    assert {i for _, i in ids(G.lineage(*graph, "none"))[0]} == {"company:c", "company:d"}


def number(x):
    """ECMAScript's text of a double, from Python's shortest digits."""
    if x == 0:
        return "0"
    sign, (digits, exponent) = "-" * (x < 0), f"{abs(x):.17e}".split("e")
    mantissa, _, power = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    point = len(whole) + int(power or 0)
    digits = (whole + part).rstrip("0") if part.strip("0") or power else (whole + part).rstrip("0")
    lead = len(digits) - len(digits.lstrip("0"))
    digits, point = digits[lead:], point - lead
    k = len(digits)
    if k <= point <= 21:
        return sign + digits + "0" * (point - k)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[0]}{'.' * (k > 1)}{digits[1:]}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def test_numbers_are_written_as_by_ecmascript(spark):
    random.seed(3)
    values = [0.0, -0.0, 1.0, -1.5, 0.1, 100.0, 1e20, 1e21, 1.5e21, 123456789.125, -12345678.5, 1e-6, 1e-7, 1.25e-7, 0.00012, 3e-5, 2.0**53, 0.1 + 0.2, 1e300, 9999999.5]
    values += [round(random.uniform(-1, 1) * 10.0 ** random.randint(-4, 9), random.randint(0, 6)) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r.t for r in df.select("v", J.js_number(F.col("v")).alias("t")).collect()}
    assert {v: t for v, t in got.items() if t != number(v)} == {}
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r.t for r in odd.select(J.js_number(F.col("v")).alias("t")).collect()] == [None] * 3


def fold(text, multiplier, start):
    data = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(data), 2):
        start = ((start ^ int.from_bytes(data[i : i + 2], "little")) * multiplier) % 2**32
    return f"{start:08x}"


def test_canonical_json_and_run_ids(spark):
    schema = "b struct<z: int, a: array<double>, `é`: string>, a string, m map<string, boolean>, c decimal(10,3), d date, n array<struct<y: string, x: long>>"
    rows = [
        ((1, [1.0, None, 2.5], 'q"\\\n\x01/é😀'), "企业", {"k2": True, "k1": False, "é": None}, None, datetime.date(2024, 7, 1), [("s", 1), (None, None)]),
        ((None, [], ""), "", {}, None, None, None), (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    whole = F.struct(*df.columns)
    kind = df.select(whole.alias("r")).schema["r"].dataType

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, datetime.date):
            return v.isoformat()
        return int(v) if isinstance(v, float) and v == int(v) else v

    got = df.select(J.canonical_json(whole, kind).alias("t"), whole.alias("r")).select("*", J.assessment_run_id(F.col("t")).alias("a"), J.technology_run_id(F.col("t")).alias("k")).collect()
    for r in got:
        want = json.dumps(plain(r["r"].asDict(recursive=True)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.t == want
        assert r.a == "kcr3-" + fold(want, 0x01000193, 0x811C9DC5)
        assert r.k == "ktr-" + fold(want, 0x01000193, 0x811C9DC5) + fold(want, 0x85EBCA6B, 0x9E3779B9)
    turned = F.struct(*df.columns[::-1])
    assert [r.t for r in df.select(J.canonical_json(turned, df.select(turned.alias("r")).schema["r"].dataType).alias("t")).collect()] == [r.t for r in got]
    at = spark.createDataFrame([("c", 1719792000123)], "c string, ms long").select(J.baseline_run_id(F.timestamp_millis("ms"), F.col("c")).alias("i"))
    prefix, time, company = at.first().i.split("-")
    assert (prefix, company, int(time, 36), time) == ("tqb", "c", 1719792000123, time.lower())
