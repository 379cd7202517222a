"""Flow-graph rules: reading and checking one graph.

A graph is small (a handful of nodes drawn by an analyst), so these helpers work
on one JSON text at a time. They run on the driver for the rules that are
compiled, and inside tasks when a whole rule table is checked.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCES = ("model", "anomaly", "case")
GATES = ("comparison", "and", "or", "not")


@dataclass
class Graph:
    """Nodes by id (the last of equal ids wins), inputs per node, alerts in order."""

    kinds: dict[str, str] = field(default_factory=dict)
    data: dict[str, dict] = field(default_factory=dict)
    inputs: dict[str, list[str]] = field(default_factory=dict)
    feeds: set[str] = field(default_factory=set)
    alerts: list[tuple[str, dict]] = field(default_factory=list)
    faults: list[tuple[str, str]] = field(default_factory=list)


def parse_graph(text) -> Graph | None:
    """A graph from JSON text or a dict; None when it is not readable."""
    if isinstance(text, str):
        try:
            text = json.loads(text)
        except ValueError:
            return None
    if not isinstance(text, dict):
        return None
    graph = Graph()
    for node in _objects(text.get("nodes"), "node", graph):
        name, kind, data = node.get("id"), node.get("type") or "", node.get("data") or {}
        if not isinstance(name, (str, int)) or not isinstance(kind, str) or not isinstance(data, dict):
            graph.faults.append(("error", "node is not readable"))
            continue
        graph.kinds[name] = kind
        graph.data[name] = data
        if kind == "alert":
            graph.alerts.append((name, data))
    for edge in _objects(text.get("edges"), "edge", graph):
        start, end = edge.get("source"), edge.get("target")
        if start and end:
            if not isinstance(start, (str, int)) or not isinstance(end, (str, int)):
                graph.faults.append(("error", "edge is not readable"))
                continue
            graph.inputs.setdefault(end, []).append(start)
            graph.feeds.add(start)
    return graph


def _objects(items, what: str, graph: Graph) -> list[dict]:
    """The objects of a JSON list; anything else in its place is a fault of the graph."""
    if items is None:
        return []
    if not isinstance(items, list):
        graph.faults.append(("error", f"{what} list is not readable"))
        return []
    graph.faults += [("error", f"{what} is not readable")] * sum(not isinstance(x, dict) for x in items)
    return [x for x in items if isinstance(x, dict)]


def is_number(text) -> bool:
    try:
        float(text)
    except (TypeError, ValueError):
        return False
    return True


def condition_key(graph: Graph) -> str:
    """Equal for graphs that fire on the same anomalies, whatever they are called or say."""
    words = ("modelId", "message", "severity", "action", "label")
    data = {n: {k: v for k, v in d.items() if k not in words} for n, d in graph.data.items()}
    return repr((graph.kinds, data, graph.inputs, [n for n, _ in graph.alerts]))


def has_cycle(graph: Graph) -> bool:
    """Whether some node feeds itself: peel off nodes without open inputs until none is left."""
    waiting = {n: {s for s in graph.inputs.get(n, []) if s in graph.kinds} for n in graph.kinds}
    while waiting:
        ready = {n for n, sources in waiting.items() if not sources}
        if not ready:
            return True
        waiting = {n: sources - ready for n, sources in waiting.items() if n not in ready}
    return False


def issues(graph: Graph | None) -> list[tuple[str, str]]:
    """(level, message) pairs; an ``error`` keeps the rule from being compiled."""
    if graph is None:
        return [("error", "graph is not readable")]
    found: list[tuple[str, str]] = list(graph.faults)
    if not graph.kinds:
        return found + [("error", "graph is empty")]
    if has_cycle(graph):
        found.append(("error", "graph has a cycle"))
    if not graph.alerts:
        found.append(("error", "no alert node"))
    if not any(kind in SOURCES for kind in graph.kinds.values()):
        found.append(("error", "no source node"))
    for name, kind in graph.kinds.items():
        data, fed, feeds = graph.data[name], bool(graph.inputs.get(name)), name in graph.feeds
        if kind == "alert":
            if not str(data.get("message") or "").strip():
                found.append(("warning", "alert without message"))
            if not fed:
                found.append(("error", "alert without input"))
        floor = data.get("minRiskScore")
        if kind == "anomaly" and floor not in (None, "") and not is_number(floor):
            found.append(("error", "threshold is not a number"))
        if any(source not in graph.kinds for source in graph.inputs.get(name, [])):
            found.append(("warning", "input from an unknown node"))
        if kind == "model" and not data.get("modelId"):
            found.append(("warning", "model node without model"))
        if kind in GATES and not fed:
            found.append(("warning", f"{kind} node without input"))
        if kind in SOURCES + GATES and not feeds:
            found.append(("warning", f"{kind} node without output"))
    return found


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [
            (rule, level, message)
            for rule, text in zip(batch["id"], batch["flow_graph"])
            for level, message in issues(parse_graph(text))
        ]
        yield pd.DataFrame(rows, columns=["rule_id", "level", "message"])


def rule_issues(rules: DataFrame) -> DataFrame:
    """Errors and warnings of every flow rule of a rule table, checked in parallel."""
    kind = rules.schema["id"].dataType.simpleString()
    flows = rules.where((F.col("rule_type") == "flow") & F.col("flow_graph").isNotNull())
    return flows.select("id", "flow_graph").mapInPandas(
        _check, f"rule_id {kind}, level string, message string"
    )


def relevant(rules: DataFrame, model_id) -> DataFrame:
    """Enabled flow rules with a model node for the model, decided inside Spark."""
    layout = "nodes ARRAY<STRUCT<type: STRING, data: STRUCT<modelId: STRING>>>"
    nodes = F.from_json("flow_graph", layout)["nodes"]
    about = F.exists(
        nodes, lambda n: (n["type"] == "model") & (n["data"]["modelId"] == str(model_id))
    )
    return rules.where(
        F.col("enabled") & (F.col("rule_type") == "flow") & F.coalesce(about, F.lit(False))
    )
