"""Truth tables of the rule nodes, graph checks, firing."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vigilspark.plans import graphs
from vigilspark.rules import fire as R
from vigilspark.rules.compile import RuleError, compile_rule
from vigilspark.rules.graph import has_cycle, issues, parse_graph, relevant, rule_issues

RISK = ("m", "model", {"output": "risk_score"})
ROWS = [
    (1, "u1", "user", 90.0, "login"),
    (2, "u2", "device", 50.0, "error"),
    (3, "u3", None, None, None),
    (4, None, "user", 0.0, "login"),
]


@pytest.fixture(scope="module")
def anomalies(spark):
    rows = [(*r, datetime(2024, 1, 1, 0, r[0])) for r in ROWS]
    return spark.createDataFrame(
        rows, "id int, entity_id string, entity_type string, risk_score double, anomaly_type string, timestamp timestamp_ntz"
    )


def fires(anomalies, nodes, edges, **extra):
    rules = [(0, parse_graph(graphs.graph(nodes + [("out", "alert", {})], edges)))]
    return {r["anomaly_id"] for r in R.evaluate(anomalies, rules, **extra).collect()}


def test_model_node(anomalies):
    assert fires(anomalies, [RISK], [("m", "out")]) == {1, 2}
    assert fires(anomalies, [("m", "model", {})], [("m", "out")]) == {1, 2}
    assert fires(anomalies, [("m", "model", {"output": "has_anomaly"})], [("m", "out")]) == {1, 2, 3, 4}
    assert fires(anomalies, [("m", "model", {"output": "other"})], [("m", "out")]) == set()


@pytest.mark.parametrize("data,want", [
    ({}, {1, 2, 3, 4}),
    ({"minRiskScore": ""}, {1, 2, 3, 4}),
    ({"minRiskScore": 0}, {1, 2, 3, 4}),
    ({"minRiskScore": "50"}, {1, 2}),
    ({"entityType": "any"}, {1, 2, 3, 4}),
    ({"entityType": "user"}, {1, 4}),
    ({"anomalyType": "login"}, {1, 4}),
    ({"anomalyType": "login", "minRiskScore": 1}, {1}),
])
def test_anomaly_node(anomalies, data, want):
    assert fires(anomalies, [("a", "anomaly", data)], [("a", "out")]) == want


def test_absent_columns_have_defaults(anomalies):
    bare = anomalies.drop("entity_type", "anomaly_type")
    assert fires(bare, [("a", "anomaly", {"entityType": "user"})], [("a", "out")]) == {1, 2, 3, 4}
    assert fires(bare, [("a", "anomaly", {"anomalyType": "x"})], [("a", "out")]) == set()


@pytest.mark.parametrize("op,want", [
    (">", {1}), ("<", {3, 4}), (">=", {1, 2}), ("<=", {2, 3, 4}), ("==", {2}), ("!=", {1, 3, 4}), ("~", set()),
])
def test_comparison_operators(anomalies, op, want):
    nodes = [RISK, ("c", "comparison", {"operator": op, "value": "50"})]
    assert fires(anomalies, nodes, [("m", "c"), ("c", "out")]) == want


def test_comparison_inputs(anomalies):
    everyone = {1, 2, 3, 4}
    compare = lambda data, nodes, edges: fires(anomalies, [*nodes, ("c", "comparison", data)], [*edges, ("c", "out")])
    assert compare({"value": "x"}, [RISK], [("m", "c")]) == {1, 2}  # bad threshold is zero
    assert compare({"value": None}, [RISK], [("m", "c")]) == {1, 2}
    assert compare({"operator": "==", "value": 0}, [], []) == everyone  # no input is zero
    assert compare({"operator": "==", "value": 0}, [], [("ghost", "c")]) == everyone
    true = ("t", "anomaly", {})
    assert compare({"operator": "==", "value": 1}, [true], [("t", "c")]) == everyone
    assert compare({"operator": "==", "value": 1}, [true, RISK], [("t", "c"), ("m", "c")]) == everyone


def test_gates(anomalies):
    everyone = {1, 2, 3, 4}
    user, high = ("u", "anomaly", {"entityType": "user"}), ("h", "anomaly", {"minRiskScore": 50})
    gate = lambda kind, nodes, edges: fires(anomalies, [*nodes, ("g", kind, {})], [*edges, ("g", "out")])
    both = [("u", "g"), ("h", "g")]
    assert gate("and", [user, high], both) == {1}
    assert gate("or", [user, high], both) == {1, 2, 4}
    assert gate("not", [user, high], both) == {2, 3}  # first input only
    assert gate("and", [], []) == set()
    assert gate("or", [], []) == set()
    assert gate("not", [], []) == everyone
    assert gate("and", [RISK], [("m", "g")]) == {1, 2}  # a number is true unless zero
    assert gate("and", [user], [("u", "g"), ("ghost", "g")]) == set()
    assert gate("odd", [user], [("u", "g")]) == set()


def test_alert_node(anomalies):
    assert fires(anomalies, [RISK], []) == set()
    graph = parse_graph(graphs.TWO_ALERTS)
    out = R.evaluate(anomalies, [(7, graph)]).orderBy("anomaly_id", "alert_node").collect()
    assert [(r["anomaly_id"], r["severity"], r["action"]) for r in out] == [
        (3, "low", "fire_alert"), (3, "medium", "create_case"), (4, "low", "fire_alert"), (4, "medium", "create_case"),
    ]
    assert out[0]["message"] == "first" and out[1]["message"] == "rule triggered"
    assert out[2]["entity_id"] == "unknown" and out[0]["entity_type"] == "user"


def test_case_node(spark, anomalies):
    cases = spark.createDataFrame(
        [(1, "open", "low"), (2, "closed", "high"), (3, "investigating", "high")], "id int, status string, severity string"
    )
    links = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (3, 4)], "case_id int, anomaly_id int")
    case = lambda data: fires(anomalies, [("k", "case", data)], [("k", "out")], cases=cases, links=links)
    assert case({}) == {1, 3}
    assert case({"caseEvent": "severity_match"}) == {3}
    assert case({"caseEvent": "severity_match", "caseSeverity": "low"}) == {1}
    assert case({"caseEvent": "other"}) == set()
    with pytest.raises(RuleError):
        fires(anomalies, [("k", "case", {})], [("k", "out")])


def test_graph_reading():
    assert parse_graph(None) is None and parse_graph("{bad") is None and parse_graph("[1]") is None
    graph = parse_graph({
        "nodes": [{"id": "a", "type": "and"}, {"id": "a", "type": "or"}, {"id": "z", "type": "alert"}],
        "edges": [{"source": "a", "target": "z"}, {"source": "", "target": "z"}, {"source": "b"}],
    })
    assert graph.kinds["a"] == "or" and graph.inputs == {"z": ["a"]}


def test_cycles_are_refused():
    graph = parse_graph(graphs.CYCLE)
    assert has_cycle(graph) and not has_cycle(parse_graph(graphs.HIGH_USER_RISK))
    with pytest.raises(RuleError):
        compile_rule(graph, ["risk_score"])
    with pytest.raises(RuleError):
        compile_rule(parse_graph(graphs.graph(
            [("a", "anomaly", {"minRiskScore": "x"}), ("o", "alert", {})], [("a", "o")])), [])


@pytest.mark.parametrize("text,want", graphs.CHECKED)
def test_issues(text, want):
    assert issues(parse_graph(text)) == want


def test_issue_rows(spark):
    rules = spark.createDataFrame(
        [(i, "flow", text) for i, (text, _) in enumerate(graphs.CHECKED)], "id int, rule_type string, flow_graph string"
    )
    assert rule_issues(rules).count() == sum(len(w) for _, w in graphs.CHECKED)


def test_relevance(spark):
    text = json.dumps({"nodes": [{"id": "m", "type": "model", "data": {"modelId": "7"}}], "edges": []})
    rows = [(1, True, "flow", text), (2, False, "flow", text), (3, True, "single-fire", text), (4, True, "flow", None),
            (5, True, "flow", "{bad"), (6, True, "flow", text.replace("7", "8"))]
    rules = spark.createDataFrame(rows, "id int, enabled boolean, rule_type string, flow_graph string")
    assert [r["id"] for r in relevant(rules, 7).collect()] == [1]


def test_fire_dedups_and_caps(spark, anomalies):
    matches = R.evaluate(anomalies, [(1, parse_graph(graphs.graph([RISK, ("out", "alert", {})], [("m", "out")])))])
    alerts = spark.createDataFrame(
        [(1, "u1", "high", datetime(2024, 1, 1, 11, 30)), (1, "u2", "high", datetime(2024, 1, 1, 11, 0))],
        "rule_id int, entity_id string, severity string, created_at timestamp_ntz",
    )
    new = R.fire(matches, alerts, "2024-01-01 12:00:00").collect()
    assert [r["entity_id"] for r in new] == ["u2"]  # exactly one hour ago no longer counts
    context = json.loads(new[0]["alert_context"])
    assert context == {"risk_score": 50.0, "anomaly_type": "error", "action": "fire_alert"}
    none = alerts.where("false")
    assert R.fire(matches, none, "2024-01-01 12:00:00", budget=1).first()["entity_id"] == "u1"


def test_single_fire_names(spark, anomalies):
    with pytest.raises(RuleError):
        R.checked_condition("reflect('java.lang.System', 'exit')")
    with pytest.raises(RuleError):
        R.checked_condition("risk_score > 1; drop table x")
    hit = anomalies.where(R.checked_condition("risk_score > 80 or anomaly_type in ('error')"))
    assert {r["id"] for r in hit.collect()} == {1, 2}


def test_deviation_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0)] * 5 + [("b", float(v)) for v in (1, 1, 1, 1, 1, 1, 1, 1, 1, 50)] + [("c", 9.0)], "e string, v double")
    out = R.deviation(df, "v", "e", 2.0).collect()
    assert [(r["e"], r["v"]) for r in out] == [("b", 50.0)]


def test_rows_are_dropped_before_the_flags_are_joined(anomalies):
    rule = lambda text: [(0, parse_graph(text))]
    kept = lambda text: {
        r["id"] for r in anomalies.where(R.could_fire(rule(text), anomalies.columns)).collect()
    }
    assert kept(graphs.OPEN_CASE_RISK) == {1, 2}
    assert kept(graphs.NO_HIGH_CASE) == {1, 2, 3, 4}
    many = [(f"k{i}", "case", {"caseEvent": "severity_match", "caseSeverity": str(i)}) for i in range(9)]
    text = graphs.graph([*many, ("g", "and", {}), RISK, ("out", "alert", {})],
                        [*[(n, "g") for n, _, _ in many], ("m", "g"), ("g", "out")])
    assert kept(text) == {r["id"] for r in anomalies.where("risk_score <> 0").collect()}


def test_many_rules_take_one_scan(anomalies, monkeypatch):
    monkeypatch.setattr(R, "CONDITIONS_PER_ARRAY", 2)
    texts = [graphs.RISK_ABOVE.replace("#", str(i)) for i in range(30)]
    out = R.evaluate(anomalies, [(i, parse_graph(x)) for i, x in enumerate(texts)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2
    risks = {r["id"]: r["risk_score"] or 0 for r in anomalies.collect()}
    assert {(r["rule_id"], r["anomaly_id"]) for r in out.collect()} == {(i, a) for i in range(30) for a, v in risks.items() if v > i}


def test_one_faulty_rule_does_not_stop_the_others(spark, anomalies):
    texts = [graphs.CYCLE, graphs.BAD_PARTS, graphs.BAD_THRESHOLD, graphs.UNREADABLE, "[]", '{"nodes": 3}', '{"nodes": [{"id": [1]}]}',
             graphs.RISK_ABOVE.replace("#", "1")]
    rules = spark.createDataFrame([(i, True, "flow", x) for i, x in enumerate(texts)],
                                  "id int, enabled boolean, rule_type string, flow_graph string")
    assert {r["rule_id"] for r in R.evaluate(anomalies, rules).collect()} == {7}
    assert {r["rule_id"] for r in R.uncompiled(rules).collect()} == set(range(7))
    assert rule_issues(rules).select("rule_id").distinct().count() >= 7


def test_one_faulty_condition_does_not_stop_the_others(spark, anomalies):
    rows = [(1, True, "single-fire", "low", "risk_score > 80"), (2, True, "single-fire", "low", "risk_score >"),
            (3, True, "single-fire", "low", "exit(1)"), (4, True, "single-fire", "low", "entity_id")]
    rules = spark.createDataFrame(rows, "id int, enabled boolean, rule_type string, severity string, condition string")
    assert {r["rule_id"] for r in R.single_fire(anomalies, rules).collect()} == {1}
    assert {2, 3, 4} == {r["rule_id"] for r in R.single_fire_issues(anomalies, rules).collect()}


def test_same_rules_share_a_condition(anomalies):
    graph = parse_graph(graphs.graph([RISK, ("out", "alert", {})], [("m", "out")]))
    out = R.evaluate(anomalies, [(i, graph) for i in range(5)])
    assert out.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").count() == 5


def test_totals_of_many_rules_compile_each_condition_once(spark, anomalies, monkeypatch):
    two = graphs.graph([RISK, ("out", "alert", {}), ("more", "alert", {"severity": "low"})], [("m", "out"), ("m", "more")])
    texts = [graphs.RISK_ABOVE.replace("#", str(i % 3 * 60)) for i in range(300)] + [two, graphs.CYCLE, graphs.BAD_PARTS, graphs.BAD_THRESHOLD, "[]", "{not", None]
    rules = spark.createDataFrame([(i, True, "flow", x) for i, x in enumerate(texts)],
                                  "id int, enabled boolean, rule_type string, flow_graph string")
    compiled, compile_one = [], R.compile_rule
    monkeypatch.setattr(R, "compile_rule", lambda graph, *a, **k: compiled.append(graph) or compile_one(graph, *a, **k))
    found = {tuple(r) for r in R.rule_totals(anomalies, rules, mins={"first": "anomaly_id"}, sums={"total": "anomaly_id"}).collect()}
    assert len(compiled) < 30
    every = R.evaluate(anomalies, rules)
    assert len(compiled) < 60
    assert found == {tuple(r) for r in every.groupBy("rule_id").agg(F.count(F.lit(1)), F.min("anomaly_id"), F.sum("anomaly_id")).collect()}
    assert (300, 4, 1, 6) in found and len(found) == 201
