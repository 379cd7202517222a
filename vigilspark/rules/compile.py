"""Flow graph to Catalyst: one boolean column per alert node.

Each node becomes a typed column, compiled once; subtrees shared by several
nodes are the same expression, which Catalyst evaluates once per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import compare, truthy
from .graph import Graph, issues


class RuleError(ValueError):
    """The graph cannot be compiled."""


@dataclass(frozen=True)
class Value:
    """A node's result with its static kind: ``bool``, ``number`` or ``none``."""

    kind: str
    column: Column | None = None


@dataclass
class Alert:
    node: str
    severity: str
    message: str
    action: str
    fires: Column


def _number(text, default: float | None) -> float:
    try:
        return float(text)
    except (TypeError, ValueError):
        if default is None:
            raise RuleError(f"not a number: {text!r}") from None
        return default


def flag_name(severity: str | None) -> str:
    """Column that tells whether the entity has an open case (of a severity)."""
    return "_open_case" if severity is None else f"_open_case_{severity}"


@dataclass
class Compiler:
    """Compiles the nodes of one graph over a table with the given columns.

    With ``unknown_cases`` the case flags are null, and so is whatever they decide.
    """

    graph: Graph
    columns: list[str]
    unknown_cases: bool = False
    flags: set[str | None] = field(default_factory=set)
    done: dict[str, Value] = field(default_factory=dict)

    def value(self, node: str) -> Value:
        if node not in self.done:
            kind = self.graph.kinds.get(node)
            build = getattr(self, f"_{kind}", None) if kind else None
            inputs = [self.value(s) for s in self.graph.inputs.get(node, [])]
            data = self.graph.data.get(node, {})
            self.done[node] = build(data, inputs) if build else Value("none")
        return self.done[node]

    def _risk(self) -> Column:
        if "risk_score" not in self.columns:
            return F.lit(0.0)
        return F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0))

    def _model(self, data: dict, inputs: list[Value]) -> Value:
        output = data.get("output", "risk_score")
        if output == "risk_score":
            return Value("number", self._risk())
        if output == "has_anomaly":
            return Value("bool", F.lit(True))
        return Value("none")

    def _anomaly(self, data: dict, inputs: list[Value]) -> Value:
        match = F.lit(True)
        floor = data.get("minRiskScore")
        if floor is not None and floor != "":
            match = match & (self._risk() >= _number(floor, None))
        # A null cell equals no filter value; only an absent column has a default.
        for key, column, default, ignored in (
            ("entityType", "entity_type", "user", "any"),
            ("anomalyType", "anomaly_type", "", ""),
        ):
            wanted = data.get(key)
            if wanted and wanted != ignored:
                held = F.col(column) if column in self.columns else F.lit(default)
                match = match & held.eqNullSafe(F.lit(wanted))
        return Value("bool", match)

    def _case(self, data: dict, inputs: list[Value]) -> Value:
        event = data.get("caseEvent", "created")
        if event not in ("created", "severity_match"):
            return Value("bool", F.lit(False))
        severity = None if event == "created" else data.get("caseSeverity", "high")
        self.flags.add(severity)
        if self.unknown_cases:
            return Value("bool", F.lit(None).cast("boolean"))
        return Value("bool", F.coalesce(F.col(flag_name(severity)), F.lit(False)))

    def _comparison(self, data: dict, inputs: list[Value]) -> Value:
        first = inputs[0] if inputs else Value("none")
        if first.kind == "none":
            held = F.lit(0.0)
        elif first.kind == "bool":
            held = F.when(first.column, 1.0).when(~first.column, 0.0)
        else:
            held = first.column
        threshold = _number(data.get("value", "0"), 0.0)
        return Value("bool", compare(held, data.get("operator", ">"), threshold))

    def _truths(self, inputs: list[Value]) -> list[Column]:
        # A condition stands as it is: it is null only where an unknown case decides.
        return [v.column if v.kind == "bool" else truthy(v.column, v.kind) for v in inputs]

    def _and(self, data: dict, inputs: list[Value]) -> Value:
        out = F.lit(bool(inputs))
        for truth in self._truths(inputs):
            out = out & truth
        return Value("bool", out)

    def _or(self, data: dict, inputs: list[Value]) -> Value:
        out = F.lit(False)
        for truth in self._truths(inputs):
            out = out | truth
        return Value("bool", out)

    def _not(self, data: dict, inputs: list[Value]) -> Value:
        return Value("bool", ~self._truths(inputs[:1])[0] if inputs else F.lit(True))

    def _alert(self, data: dict, inputs: list[Value]) -> Value:
        return self._or(data, inputs)


def compile_rule(
    graph: Graph, columns: list[str], unknown_cases: bool = False
) -> tuple[list[Alert], set[str | None]]:
    """The alerts of a graph and the case flags they need; a faulty graph raises ``RuleError``."""
    # A graph that is only empty or unconnected compiles and never fires.
    for fault in graph.faults + [x for x in issues(graph) if x == ("error", "graph has a cycle")]:
        raise RuleError(fault[1])
    compiler = Compiler(graph, columns, unknown_cases)
    try:
        alerts = [
            Alert(
                node,
                str(data.get("severity", "high")),
                str(data.get("message", "rule triggered")),
                str(data.get("action", "fire_alert")),
                compiler.value(node).column,
            )
            for node, data in graph.alerts
        ]
    except (TypeError, AttributeError) as error:
        raise RuleError(f"graph cannot be read: {error}") from error
    return alerts, compiler.flags
