"""Evaluating rules over the anomaly table and turning matches into alerts."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import moment
from ..operators.joins import ALERT_KEYS, not_recently_alerted, with_case_flags
from ..operators.ranking import budget_places, within_budget
from ..operators.scan import null_safe_join
from ..operators.suppress import suppress
from ..session import written
from .compile import RuleError, compile_rule, flag_name
from .graph import condition_key, issues, parse_graph, relevant

# Conditions in one array of the generated code; more of them make more arrays, not more scans.
CONDITIONS_PER_ARRAY = 100


def collect_rules(rules: DataFrame, model_id=None) -> list[tuple]:
    """(id, graph) of the enabled flow rules, for one model or for all, in id order.

    Rules that cannot be read or compiled are left out; ``rule_issues`` and
    ``uncompiled`` name them. Each distinct condition is tried once. The driver holds
    the table: every match names its rule, so the matches outgrow the rules by far.
    ``rule_totals`` does without.
    """
    rows = _enabled(rules, model_id).collect()
    parsed = [(r["id"], parse_graph(r["flow_graph"])) for r in sorted(rows, key=lambda r: r["id"])]
    kept = [(rule, graph) for rule, graph in parsed if graph is not None and graph.alerts and not graph.faults]
    sound = {key for key, graph in _distinct(kept).items() if fault_of(graph) is None}
    return [(rule, graph) for rule, graph in kept if condition_key(graph) in sound]


def _enabled(rules: DataFrame, model_id) -> DataFrame:
    """``id, flow_graph`` of the enabled flow rules, for one model or for all."""
    if model_id is not None:
        found = relevant(rules, model_id)
    else:
        found = rules.where(F.col("enabled") & (F.col("rule_type") == "flow"))
    return found.where(F.col("flow_graph").isNotNull()).select("id", "flow_graph")


def fault_of(graph) -> str | None:
    """Why a graph cannot be compiled, or None."""
    try:
        compile_rule(graph, [])
    except RuleError as error:
        return str(error)
    return None


def required_flags(rules: list[tuple], columns: list[str]) -> dict[str, str | None]:
    """Case-flag columns the rules refer to: name -> severity or None."""
    wanted: set[str | None] = set()
    for graph in _distinct(rules).values():
        wanted |= compile_rule(graph, columns)[1]
    return {flag_name(s): s for s in sorted(wanted, key=str)}


def _distinct(rules: list[tuple]) -> dict[str, object]:
    """One graph for each condition that some rule has."""
    return {condition_key(g): g for _, g in reversed(rules)}


def could_fire(rules: list[tuple], columns: list[str]) -> Column:
    """True unless surely no alert fires, whatever the case flags turn out to be.

    Lets the scan drop rows before the flags are joined. An unknown flag is null,
    and a row goes only where three-valued logic gives false for every alert.
    """
    chances = [a.fires for g in _distinct(rules).values() for a in compile_rule(g, columns, unknown_cases=True)[0]]
    return F.coalesce(reduce(lambda a, b: a | b, chances), F.lit(True)) if chances else F.lit(False)


# Issues that keep a rule from being compiled.
FATAL = ("graph is empty", "graph has a cycle", "threshold is not a number", "node is not readable", "edge is not readable",
         "node list is not readable", "edge list is not readable")
MATCH_FIELDS = "_code int, rule_id {kind}, rule_order int, alert_node int, severity string, message string, action string"


def _hits(anomalies: DataFrame, graphs: dict[str, object]) -> tuple[DataFrame, dict[tuple, int]]:
    """(anomalies with the ``_code`` of each condition that fires, codes by condition and alert node).

    Each condition is evaluated once, in one pass over the anomalies.
    """
    columns = anomalies.columns
    conditions: dict[tuple, int] = {}
    fired: list[Column] = []
    for key, graph in graphs.items():
        for i, alert in enumerate(compile_rule(graph, columns)[0]):
            conditions[key, i] = len(fired)
            fired.append(alert.fires)

    def given(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in columns else F.lit(default)

    numbers = [F.when(c, F.lit(i)) for i, c in enumerate(fired)]
    arrays = [F.array(*numbers[at : at + CONDITIONS_PER_ARRAY]) for at in range(0, len(numbers), CONDITIONS_PER_ARRAY)]
    codes = F.filter(F.concat(*arrays), lambda c: c.isNotNull()) if arrays else F.expr("CAST(array() AS array<int>)")
    model = F.col("model_id") if "model_id" in columns else F.lit(None).cast("string")
    details = F.col("details") if "details" in columns else F.lit(None).cast("string")
    what = F.col("anomaly_type") if "anomaly_type" in columns else F.lit(None).cast("string")
    hits = anomalies.select(
        F.col("id").alias("anomaly_id"),
        given("entity_id", "unknown").alias("entity_id"),
        given("entity_type", "user").alias("entity_type"),
        F.col("risk_score"),
        what.alias("anomaly_type"),
        model.alias("model_id"),
        details.alias("details"),
        F.col("timestamp").alias("event_time"),
        F.explode(codes).alias("_code"),
    )
    return hits, conditions


def _said(data: dict) -> tuple[str, str, str]:
    """Severity, message and action of an alert node."""
    return str(data.get("severity", "high")), str(data.get("message", "rule triggered")), str(data.get("action", "fire_alert"))


def match(anomalies: DataFrame, rules: list[tuple]) -> DataFrame:
    """One row per anomaly and alert node that fires. Stateless, so it also runs on a stream.

    ``anomalies`` carries the case flags the rules need. Each distinct condition is
    evaluated once, in one pass over the anomalies for any number of rules; the
    numbers of those that fire are exploded and joined to the alerts that have them.
    """
    hits, conditions = _hits(anomalies, _distinct(rules))
    texts = []
    for order, (rule_id, graph) in enumerate(rules):
        key = condition_key(graph)
        for i, (_, data) in enumerate(graph.alerts):
            texts.append((conditions[key, i], rule_id, order, i, *_said(data)))
    kind = "string" if texts and isinstance(texts[0][1], str) else "long"
    known = anomalies.sparkSession.createDataFrame(texts, MATCH_FIELDS.format(kind=kind))
    return hits.join(known, "_code").drop("_code")


def _rule_table(rules: DataFrame, model_id=None) -> tuple[dict[str, object], DataFrame]:
    """(a graph for each distinct condition that compiles, by its key; ``rule_id, _key, alert_node`` of all readable rules).

    The rules are dealt out by id and read in tasks, as a small file may hold very many.
    The driver gets one text for each distinct condition.
    """

    def read(batches):
        seen: set[str] = set()
        for batch in batches:
            found = []
            for rule_id, text in zip(batch.column("id").to_pylist(), batch.column("flow_graph").to_pylist()):
                graph = parse_graph(text)
                if graph is None or graph.faults or not graph.alerts:
                    continue
                key = hashlib.sha256(condition_key(graph).encode("utf-8", "surrogatepass")).hexdigest()
                found += [(rule_id, key, i, None if i or key in seen else text) for i in range(len(graph.alerts))]
                seen.add(key)
            columns = list(zip(*found)) or [(), (), (), ()]
            kinds = [batch.schema.field("id").type, pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["rule_id", "_key", "alert_node", "_text"])

    kind = rules.schema["id"].dataType.simpleString()
    table = written(
        _enabled(rules, model_id).repartition("id").mapInArrow(read, f"rule_id {kind}, _key string, alert_node int, _text string"), "rules")
    texts = table.where(F.col("_text").isNotNull()).groupBy("_key").agg(F.min("_text").alias("_text")).collect()
    graphs = {r["_key"]: parse_graph(r["_text"]) for r in sorted(texts)}
    return {key: graph for key, graph in graphs.items() if fault_of(graph) is None}, table.drop("_text")


def rule_totals(
    anomalies: DataFrame, rules: DataFrame, model_id=None,
    cases: DataFrame | None = None, links: DataFrame | None = None,
    mins: dict[str, str] | None = None, sums: dict[str, str] | None = None,
) -> DataFrame:
    """``rule_id, n`` and totals of what ``evaluate`` finds, for the rules that match something.

    ``mins`` and ``sums`` map an output column to a column of the matches. Rules with
    the same condition have the same matches, so these are added up once for each
    distinct condition and no match is repeated for each rule.
    """
    mins, sums = mins or {}, sums or {}
    graphs, table = _rule_table(rules, model_id)
    hits, conditions = _hits(_with_flags(anomalies, list(graphs.items()), cases, links), graphs)
    least = [F.min(v).alias(o) for o, v in mins.items()]
    by_code = hits.groupBy("_code").agg(F.count(F.lit(1)).alias("n"), *least, *[F.sum(v).alias(o) for o, v in sums.items()])
    codes = anomalies.sparkSession.createDataFrame(
        [(key, i, code) for (key, i), code in conditions.items()], "_key string, alert_node int, _code int")
    # A rule may have several alert nodes.
    return table.join(codes.join(by_code, "_code"), ["_key", "alert_node"]).groupBy("rule_id").agg(
        F.sum("n").alias("n"), *[F.min(o).alias(o) for o in mins], *[F.sum(o).alias(o) for o in sums])


def uncompiled(rules: DataFrame) -> DataFrame:
    """``rule_id, fault`` of the enabled flow rules that evaluation leaves out, checked in parallel."""
    kind = rules.schema["id"].dataType.simpleString()

    def check(batches):
        for batch in batches:
            graphs = [parse_graph(text) for text in batch["flow_graph"]]
            faults = ["graph is not readable" if g is None else "no alert node" if not g.alerts else
                      next((m for level, m in issues(g) if level == "error" and m in FATAL), None) for g in graphs]
            yield batch.assign(rule_id=batch["id"], fault=faults)[["rule_id", "fault"]].dropna(subset="fault")

    chosen = rules.where(F.col("enabled") & (F.col("rule_type") == "flow") & F.col("flow_graph").isNotNull())
    return chosen.select("id", "flow_graph").mapInPandas(check, f"rule_id {kind}, fault string")


def evaluate(
    anomalies: DataFrame, rules: DataFrame | list[tuple], model_id=None,
    cases: DataFrame | None = None, links: DataFrame | None = None,
    known_anomalies: DataFrame | None = None,
) -> DataFrame:
    """Matches of the enabled flow rules, with the case flags joined in when a rule needs them.

    One faulty rule does not keep the others from being evaluated.
    """
    compiled = collect_rules(rules, model_id) if isinstance(rules, DataFrame) else rules
    return match(_with_flags(anomalies, compiled, cases, links, known_anomalies), compiled)


def _with_flags(
    anomalies: DataFrame, rules: list[tuple], cases: DataFrame | None, links: DataFrame | None,
    known_anomalies: DataFrame | None = None,
) -> DataFrame:
    """Anomalies that may fire, with the case flags that the rules need."""
    flags = required_flags(rules, anomalies.columns)
    if not flags:
        return anomalies
    if cases is None or links is None:
        raise RuleError("a case node needs the case tables")
    known = known_anomalies if known_anomalies is not None else anomalies
    anomalies = anomalies.where(could_fire(rules, anomalies.columns))
    return with_case_flags(anomalies, cases, links, known, flags)


def alert_rows(matches: DataFrame, created_at: Column) -> DataFrame:
    """Matches in the layout of the alert table."""
    context = F.to_json(
        F.struct(
            "risk_score", "anomaly_type", "model_id", "action",
            F.when(F.length("details") > 0, F.col("details")).alias("anomaly_details"),
        )
    )
    key = F.concat_ws("|", F.col("rule_id").cast("string"), F.col("anomaly_id").cast("string"), F.col("alert_node").cast("string"))
    return matches.select(
        F.sha2(key, 256).alias("id"), "rule_id", "severity", "message", "entity_id", "entity_type",
        context.alias("alert_context"), F.lit(False).alias("acknowledged"),
        created_at.alias("created_at"),
    )


def fire(
    matches: DataFrame, alerts: DataFrame, as_of, budget: int | None = None, mode: str = "run",
    interval: str = "1 hour",
) -> DataFrame:
    """New alerts: not recently alerted, one per key, all of them unless a budget is given.

    ``mode="run"`` keeps the riskiest match of a key (the clock stands still
    during a run); ``mode="event"`` applies the interval to the event times.
    A budget is exact and filled in rule order, riskiest anomalies first;
    ``dropped_by_budget`` counts what it leaves out.
    """
    kept, created = _new_matches(matches, alerts, as_of, mode, interval)
    return alert_rows(kept if budget is None else within_budget(kept, budget, BUDGET_ORDER), created)


# Rules in order, riskiest anomalies first; null risk counts as zero.
BUDGET_ORDER = ["rule_order", "-risk_score", "anomaly_id", "alert_node"]


def dropped_by_budget(
    matches: DataFrame, alerts: DataFrame, as_of, budget: int, mode: str = "run", interval: str = "1 hour"
) -> DataFrame:
    """``rule_id, kept, dropped`` of the new alerts under a budget."""
    kept, _ = _new_matches(matches, alerts, as_of, mode, interval)
    placed = budget_places(kept, BUDGET_ORDER)
    return placed.groupBy("rule_id").agg(
        F.count_if(F.col("_place") <= budget).alias("kept"), F.count_if(F.col("_place") > budget).alias("dropped"))


def _new_matches(matches: DataFrame, alerts: DataFrame, as_of, mode: str, interval: str) -> tuple[DataFrame, Column]:
    fresh = not_recently_alerted(matches, alerts, as_of, interval)
    if mode == "run":
        fields = [c for c in fresh.columns if c not in ALERT_KEYS]
        best = fresh.groupBy(*ALERT_KEYS).agg(
            F.min_by(
                F.struct(*fields),
                F.struct("rule_order", -F.coalesce("risk_score", F.lit(0.0)), "anomaly_id", "alert_node"),
            ).alias("_m")
        )
        kept, created = best.select(*ALERT_KEYS, "_m.*"), moment(as_of)
    else:
        parts = [F.col(c).cast("string") for c in ("anomaly_id", "rule_order", "alert_node")]
        # Read several times below; the rules are evaluated once.
        named = written(fresh.withColumn("_key", F.concat_ws("|", *parts)), "matches")
        kept = suppress(named, ALERT_KEYS, "event_time", interval, "event", "_key").drop("_key")
        created = F.col("event_time")
    return kept, created


def last_triggered(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Rules with the time of their latest alert."""
    latest = alerts.groupBy(F.col("rule_id").alias("id")).agg(F.max("created_at").alias("last_triggered_at"))
    return rules.drop("last_triggered_at").join(latest, "id", "left")


# What a single-fire condition may name.
CONDITION_COLUMNS = ("risk_score", "entity_id", "entity_type", "anomaly_type", "model_id", "acknowledged")
_WORDS = ("and", "or", "not", "is", "null", "in", "between", "like", "true", "false")
_TOKEN = re.compile(r"\s*('[^']*'|\d+(?:\.\d+)?|[A-Za-z_]\w*|<=|>=|<>|!=|==|[<>=(),])")


def checked_condition(text: str) -> Column:
    """A condition over the allowed columns as a column; anything else is refused."""
    at = 0
    while at < len(text.rstrip()):
        token = _TOKEN.match(text, at)
        if not token:
            raise RuleError(f"condition not allowed: {text!r}")
        word = token.group(1)
        if re.match(r"[A-Za-z_]", word) and word.lower() not in _WORDS + CONDITION_COLUMNS:
            raise RuleError(f"name not allowed in a condition: {word!r}")
        at = token.end()
    return F.expr(text)


def condition_faults(anomalies: DataFrame, texts: list[str]) -> dict[str, str]:
    """Why each condition that cannot be evaluated over ``anomalies`` is refused."""
    faults = {}
    for text in texts:
        try:
            kind = anomalies.select(checked_condition(text)).schema[0].dataType.simpleString()
            if kind != "boolean":
                faults[text] = f"condition is of type {kind}"
        except (RuleError, PySparkException) as error:
            faults[text] = str(error).split("\n")[0]
    return faults


def single_fire(anomalies: DataFrame, rules: DataFrame) -> DataFrame:
    """Anomalies that meet the condition of an enabled single-fire rule.

    A condition that is not allowed or cannot be read leaves out its own rules only;
    ``single_fire_issues`` names them.
    """
    chosen, texts = _conditions(rules)
    faults = condition_faults(anomalies, texts)
    hits = [F.when(checked_condition(c), F.lit(c)) for c in texts if c not in faults]
    arrays = [F.array(*hits[at : at + CONDITIONS_PER_ARRAY]) for at in range(0, len(hits), CONDITIONS_PER_ARRAY)]
    met = F.filter(F.concat(*arrays), lambda c: c.isNotNull()) if arrays else F.expr("CAST(array() AS array<string>)")
    found = anomalies.select(
        F.col("id").alias("anomaly_id"), "entity_id", "risk_score", F.explode(met).alias("condition")
    )
    return found.join(chosen.select(F.col("id").alias("rule_id"), "severity", "condition"), "condition")


def single_fire_issues(anomalies: DataFrame, rules: DataFrame) -> DataFrame:
    """``rule_id, condition, fault`` of the enabled single-fire rules that are left out."""
    chosen, texts = _conditions(rules)
    faults = anomalies.sparkSession.createDataFrame(
        list(condition_faults(anomalies, texts).items()), "condition string, fault string")
    return chosen.join(faults, "condition").select(F.col("id").alias("rule_id"), "condition", "fault")


def _conditions(rules: DataFrame) -> tuple[DataFrame, list[str]]:
    """Enabled single-fire rules, and their distinct conditions; each is evaluated once."""
    chosen = rules.where(F.col("enabled") & (F.col("rule_type") == "single-fire") & F.col("condition").isNotNull())
    return chosen, sorted(r[0] for r in chosen.select("condition").distinct().collect())


def deviation(df: DataFrame, value: str, entity: str, k: float = 3.0) -> DataFrame:
    """Rows whose value is more than ``k`` deviations from its entity's mean.

    The mean and deviation come from exact decimal sums, so they do not depend
    on row order. No deviation, or none defined, means no match.
    """
    x = F.col(value).cast("decimal(18,4)")
    stats = df.where(F.col(value).isNotNull()).groupBy(entity).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(x).cast("double").alias("_s"),
        F.sum(x * x).cast("double").alias("_q"),
    )
    mean = F.col("_s") / F.col("_n")
    variance = (F.col("_q") - F.col("_s") * mean) / (F.col("_n") - 1)
    stats = stats.where(F.col("_n") > 1).select(
        entity, mean.alias("_mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("_std")
    ).where(F.col("_std") > 0)
    z = (F.col(value) - F.col("_mean")) / F.col("_std")
    return (
        null_safe_join(df, stats, [entity], "inner")
        .withColumn("z_score", z)
        .where(F.abs("z_score") > k)
        .drop("_mean", "_std")
    )
