"""The flow graphs used by the checked rule queries."""

from __future__ import annotations

import json


def graph(nodes: list[tuple], edges: list[tuple]) -> str:
    """JSON text of (id, type, data) nodes and (source, target) edges."""
    return json.dumps({
        "nodes": [{"id": i, "type": k, "data": d} for i, k, d in nodes],
        "edges": [{"id": f"e{n}", "source": s, "target": t} for n, (s, t) in enumerate(edges)],
    })


RISK = ("m", "model", {"modelId": "@", "output": "risk_score"})

HIGH_USER_RISK = graph(
    [RISK, ("c", "comparison", {"operator": ">", "value": "80"}), ("a", "anomaly", {"entityType": "user"}),
     ("g", "and", {}), ("out", "alert", {"severity": "high", "message": "high user risk"})],
    [("m", "c"), ("c", "g"), ("a", "g"), ("g", "out")],
)
DEVICE_ERRORS = graph(
    [("m", "model", {"modelId": "@"}),
     ("a", "anomaly", {"minRiskScore": 50, "entityType": "device", "anomalyType": "error"}),
     ("out", "alert", {"severity": "critical", "message": "device errors"})],
    [("a", "out")],
)
OPEN_CASE_RISK = graph(
    [("k", "case", {"caseEvent": "created"}), RISK, ("c", "comparison", {"operator": ">=", "value": 50}),
     ("g", "and", {}), ("out", "alert", {"message": "risk with open case"})],
    [("k", "g"), ("m", "c"), ("c", "g"), ("g", "out")],
)
NO_HIGH_CASE = graph(
    [("k", "case", {"caseEvent": "severity_match", "caseSeverity": "high"}), ("n", "not", {}),
     ("m", "model", {"modelId": "@", "output": "has_anomaly"}),
     ("c", "comparison", {"operator": "==", "value": "2"}), ("g", "or", {}), ("out", "alert", {"severity": "low"})],
    [("k", "n"), ("n", "g"), ("m", "c"), ("c", "g"), ("g", "out")],
)
TWO_ALERTS = graph(
    [RISK, ("c", "comparison", {"operator": "<=", "value": "1"}), ("x", "alert", {"severity": "low", "message": "first"}),
     ("y", "alert", {"severity": "medium", "action": "create_case"})],
    [("m", "c"), ("c", "x"), ("c", "y")],
)
GRAPHS = [HIGH_USER_RISK, DEVICE_ERRORS, OPEN_CASE_RISK, NO_HIGH_CASE, TWO_ALERTS]

CYCLE = graph(
    [("p", "and", {}), ("q", "or", {}), RISK, ("out", "alert", {"message": "loop"})],
    [("m", "p"), ("p", "q"), ("q", "p"), ("q", "out")],
)
NO_ALERT = graph([RISK, ("c", "comparison", {})], [("m", "c")])
BARE = graph([("out", "alert", {}), ("m", "model", {})], [])
UNREADABLE = "{not json"
BAD_PARTS = '{"nodes": [null, "x", {"id": "o", "type": "alert", "data": {"message": "m"}}], "edges": ["y"]}'
BAD_THRESHOLD = graph(
    [("a", "anomaly", {"minRiskScore": "x"}), ("out", "alert", {"message": "m"})], [("a", "out")],
)
# "#" is replaced by a number.
RISK_ABOVE = graph(
    [("m", "model", {"output": "risk_score"}), ("c", "comparison", {"operator": ">", "value": "#"}),
     ("out", "alert", {"severity": "low"})],
    [("m", "c"), ("c", "out")],
)
# For the checks: graph text, then the issues it must raise.
CHECKED = [
    (HIGH_USER_RISK, []),
    (CYCLE, [("error", "graph has a cycle")]),
    (NO_ALERT, [("error", "no alert node"), ("warning", "comparison node without output")]),
    (BARE, [("warning", "alert without message"), ("error", "alert without input"),
            ("warning", "model node without model"), ("warning", "model node without output")]),
    (UNREADABLE, [("error", "graph is not readable")]),
    ("{}", [("error", "graph is empty")]),
    (BAD_PARTS, [("error", "node is not readable"), ("error", "node is not readable"), ("error", "edge is not readable"),
                 ("error", "no source node"), ("error", "alert without input")]),
    (BAD_THRESHOLD, [("error", "threshold is not a number")]),
]


def sql_case(selector: str, texts: list[str], model: str) -> str:
    """SQL for the text chosen by ``selector`` with the model number put in, braces escaped for format()."""
    arms = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(texts))
    escaped = arms.replace("{", "{{").replace("}", "}}")
    return f"replace(CASE {selector} {escaped} END, '@', CAST({model} AS STRING))"
