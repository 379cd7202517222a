"""Graph detectors over edge tables: building, PageRank, reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, written
from .base import Artifact, Detector
from .risk import centrality_risk


def build_edges(df: DataFrame, src: str | None = None, dst: str | None = None) -> DataFrame:
    """Distinct undirected pairs ``(a, b)`` with ``a <= b``; self-loops stay.

    Columns that are not there fall back to the first two of the table.
    """
    src, dst = src or "source", dst or "target"
    if src not in df.columns or dst not in df.columns:
        if len(df.columns) < 2:
            raise ValueError("a graph needs two columns")
        src, dst = df.columns[:2]
    s, d = F.col(src).cast("string"), F.col(dst).cast("string")
    return (
        df.where(s.isNotNull() & d.isNotNull())
        .select(F.least(s, d).alias("a"), F.greatest(s, d).alias("b"))
        .distinct()
    )


def graph_summary(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    return edges.agg(F.count(F.lit(1)).alias("edges")).select(
        ends.agg(F.count_distinct("node")).scalar().alias("nodes"), "edges"
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """Each pair in both directions, a self-loop once."""
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                   F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    kept = F.when(F.col("a") == F.col("b"), F.slice(ends, 1, 1)).otherwise(ends)
    return edges.select(F.inline(kept))


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Write once, pre-shuffled by ``keys``, so that every later join reads it in place."""
    return _in_buckets(df.repartition(buckets, *keys), keys, buckets)


def _in_buckets(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The same for rows that a shuffle by ``keys`` into as many partitions has just left in place."""
    spark = df.sparkSession
    name = f"vigil_edges_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", scratch_path(spark, "edges")).saveAsTable(name)
    table = spark.table(name)
    # The plan holds the files and their layout; the name is not needed any more.
    spark.sql(f"DROP TABLE {name}")
    return table


def adjacency(edges: DataFrame, hub_edges: int = 200_000) -> tuple[DataFrame, list[str], DataFrame]:
    """Edges in both directions, shuffled and written once; their keys; and ``node, deg, pieces`` of every node.

    Buckets follow ``src``. If a node has more than ``hub_edges`` edges they follow ``(src, salt)``
    instead, and such a node is cut into ``pieces``, so no bucket holds all its edges. The node table
    is bucketed like a shuffle by node, which therefore meets it in place.
    """
    directed = both_ways(edges)
    degree = written(directed.groupBy("src").agg(F.count(F.lit(1)).alias("deg")), "degree")
    m = degree.agg(F.sum("deg")).first()[0] or 0
    # At most 1/hub_edges of all edges can be hubs.
    hubs = degree.where(F.col("deg") > hub_edges).select(
        "src", F.ceil(F.col("deg") / hub_edges).cast("int").alias("pieces")
    )
    # Fewer buckets than shuffle partitions would make Spark shuffle the edges
    # again; more than the catalog's limit (100,000) are refused.
    shuffle_partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffle_partitions, min(int(m // 5_000_000) + 1, 50_000))
    # Without hubs a node's edges lie where its rank is summed, and nothing but the sums moves.
    salt = [] if hubs.isEmpty() else ["salt"]
    salted = (
        directed.join(hubs, "src", "left").select(
            "src", "dst", F.pmod(F.xxhash64("dst"), F.coalesce("pieces", F.lit(1))).cast("int").alias("salt"))
        if salt else directed
    )
    nodes = degree.join(hubs, "src", "left").select(
        F.col("src").alias("node"), "deg", F.coalesce("pieces", F.lit(1)).alias("pieces")
    )
    return _bucketed(salted, ["src", *salt], buckets), ["src", *salt], _bucketed(nodes, ["node"], shuffle_partitions)


def _to_edges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``node`` and ``pieces``, one for each place where the node's edges lie."""
    pieces = [F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("salt")] if "salt" in keys else []
    rest = [c for c in rows.columns if c not in ("node", "pieces")]
    return rows.select(F.col("node").alias("src"), *rest, *pieces)


def pagerank(
    edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6,
    fixed_iter: int | None = None, hub_edges: int = 200_000, keep_every: int = 5,
) -> DataFrame:
    """PageRank of an undirected graph: ``node, rank``, summing to one.

    Stops when the ranks move by less than ``N * tol`` in total, or after
    ``fixed_iter`` steps. Edges are shuffled and written once, bucketed by ``src``.
    If a hub has more than ``hub_edges`` edges they are spread by ``(src, salt)``
    instead: a hub is cut into salted pieces, so no bucket holds all its edges. Every
    step then shuffles map-side-combined contributions, and with hubs the ranks too.
    """
    table, keys, nodes = adjacency(edges, hub_edges)
    n = nodes.count()
    if not n:
        raise ValueError("the graph has no edges")
    ranks = nodes.select("node", F.lit(1.0 / n).alias("rank"))
    steps = fixed_iter if fixed_iter is not None else max_iter
    for i in range(1, steps + 1):
        shares = ranks.join(nodes, "node").select("node", "pieces", (F.col("rank") / F.col("deg")).alias("share"))
        # In an undirected graph every node receives something and none dangles.
        moved = table.join(_to_edges(shares, keys), keys).groupBy("dst").agg(
            ((1.0 - alpha) / n + alpha * F.sum("share")).alias("rank")
        ).withColumnRenamed("dst", "node")
        if fixed_iter is not None:
            ranks = written(moved, "ranks") if i % keep_every == 0 and i < steps else moved
            continue
        previous, ranks = ranks, written(moved, "ranks")
        change = (
            ranks.join(previous.withColumnRenamed("rank", "before"), "node")
            .agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("d")).first()["d"]
        )
        if change < n * tol:
            break
    return ranks


def k_hop(edges: DataFrame, start: list[str] | DataFrame, k: int) -> DataFrame:
    """Nodes within ``k`` hops of the start nodes, with the smallest hop count."""
    directed = written(both_ways(edges), "directed")
    if isinstance(start, DataFrame):
        frontier = start.select(F.col(start.columns[0]).cast("string").alias("node")).distinct()
    else:
        frontier = edges.sparkSession.createDataFrame([(str(s),) for s in start], "node string").distinct()
    known = directed.select(F.col("src").alias("node"))
    fresh = written(frontier.join(known, "node", "left_semi").withColumn("hop", F.lit(0)), "hop")
    visited = fresh
    edge_to = directed.select(F.col("src").alias("node"), "dst")
    for hop in range(1, k + 1):
        # The frontier holds each node once, so a hub's edges are the side AQE splits.
        reached = edge_to.join(fresh.select("node"), "node").select(F.col("dst").alias("node")).distinct()
        unseen = reached.join(visited.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        fresh = written(unseen, "hop")
        visited = visited.unionByName(fresh)
    return visited


#: Starts that one walk carries, one bit each.
STARTS = 63


def reach_step(table: DataFrame, keys: list[str], nodes: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """``node, mask`` of what the last of ``hops`` reaches over one edge and no hop has reached before.

    Masks are merged before and after the one shuffle, by ``dst``; edges, nodes and hops lie in
    buckets and stay where they are (with hubs the last hop is spread to their pieces).
    """
    front = hops[-1] if len(keys) == 1 else hops[-1].join(nodes.select("node", "pieces"), "node")
    reached = table.join(_to_edges(front, keys), keys).groupBy("dst").agg(F.bit_or("mask").alias("mask"))
    reached = reached.withColumnRenamed("dst", "node")
    known = F.lit(0).cast("long")
    for i, hop in enumerate(hops):
        reached = reached.join(hop.select("node", F.col("mask").alias(f"m{i}")), "node", "left")
        known = known.bitwiseOR(F.coalesce(f"m{i}", F.lit(0).cast("long")))
    return reached.select("node", F.col("mask").bitwiseAND(F.bitwise_not(known)).alias("mask")).where("mask <> 0")


def k_hop_many(edges: DataFrame, starts: list, k: int, hub_edges: int = 200_000) -> DataFrame:
    """``start, node, hop``: nodes within ``k`` hops of each start, with the smallest hop count.

    Up to 63 starts walk together, as bits of one mask per node; a longer list walks in groups.
    Starts that are no nodes reach nothing.
    """
    spark = edges.sparkSession
    table, keys, nodes = adjacency(edges, hub_edges)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names, found = sorted({str(s) for s in starts if s is not None}), None
    for at in range(0, len(names), STARTS):
        group = names[at : at + STARTS]
        first = spark.createDataFrame([(name, 1 << i) for i, name in enumerate(group)], "node string, mask bigint")
        hops = [_bucketed(first.join(nodes.select("node"), "node", "left_semi"), ["node"], partitions)]
        for _ in range(k):
            hops.append(_in_buckets(reach_step(table, keys, nodes, hops), ["node"], partitions))
        bits = F.filter(F.sequence(F.lit(0), F.lit(len(group) - 1)),
                        lambda i: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
        start = F.element_at(F.array(*[F.lit(name) for name in group]), F.col("bit") + 1)
        for hop, reached in enumerate(hops):
            rows = reached.select("node", F.explode(bits).alias("bit")).select(start.alias("start"), "node", F.lit(hop).alias("hop"))
            found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], "start string, node string, hop int")


class CentralityDetector(Detector):
    """Central nodes of a graph as risky entities."""

    kind = "centrality"

    def __init__(self, source: str | None = None, target: str | None = None, **rank_options):
        self.source = source
        self.target = target
        self.rank_options = rank_options

    def fit(self, df: DataFrame, params: dict | None = None) -> Artifact:
        params = params or {}
        source = params.get("source_column", self.source)
        target = params.get("target_column", self.target)
        return Artifact(self.kind, {}, {"edges": written(build_edges(df, source, target), "graph")})

    def score(self, df: DataFrame, artifact: Artifact) -> DataFrame:
        ranks = pagerank(artifact.tables["edges"], **self.rank_options)
        return centrality_risk(ranks).select(
            F.col("node").alias("entity_id"), "risk_score", "anomaly_type",
            F.to_json(F.struct(F.col("rank").alias("pagerank"))).alias("details"),
        )
