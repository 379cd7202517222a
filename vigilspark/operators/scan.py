"""Order-dependent operators that survive a hot key.

``Window.partitionBy(entity)`` puts every row of an entity in one task. Here the
rows are range-partitioned on the full sort order instead, so an entity holding
a third of the table is spread over a third of the tasks. Each slice is scanned
on its own; the slice totals (one row per key and slice) are scanned next and
joined back as the value carried into the slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left"
) -> DataFrame:
    """Equi-join in which null keys match each other; keeps the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _sort(order: list[str]) -> list[Column]:
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in slices of similar size that follow the order ``keys + order``.

    The slice number is stored with the rows, so all consumers agree on it even
    if a lost task would sample other range bounds.
    """
    placed = df.repartitionByRange(*[F.col(k).asc() for k in keys], *_sort(order))
    return written(placed.withColumn("_slice", F.spark_partition_id()), "ranges")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, str] | None = None,
    lags: dict[str, str] | None = None,
    fills: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums, previous-row values and last non-null values.

    ``sums``, ``lags`` and ``fills`` map an output column to its input column.
    ``order`` must identify a row within its key for a deterministic result; a
    leading ``-`` sorts that column downwards (sums only).
    """
    sums, lags, fills = sums or {}, lags or {}, fills or {}
    if (lags or fills) and any(c.startswith("-") for c in order):
        raise ValueError("previous values need an ascending order")
    sort = _sort(order)
    placed = ranged(df, keys, order)
    slice_keys = ["_slice", *keys]
    inside = Window.partitionBy(*slice_keys).orderBy(*sort)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        "*",
        *[F.sum(v).over(upto).alias(o) for o, v in sums.items()],
        *[F.lag(v).over(inside).alias(o) for o, v in lags.items()],
        *[F.last(v, ignorenulls=True).over(upto).alias(o) for o, v in fills.items()],
        F.row_number().over(inside).alias("_pos"),
    )
    totals = placed.groupBy(*slice_keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(v).alias(f"_t_{o}") for o, v in sums.items()],
        *[F.max_by(F.struct(v), F.struct(*order)).alias(f"_l_{o}") for o, v in lags.items()],
        *[
            F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"_f_{o}")
            for o, v in fills.items()
        ],
    )
    before = Window.partitionBy(*keys).orderBy("_slice")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *slice_keys,
        *[F.sum(f"_t_{o}").over(earlier).alias(f"_c_{o}") for o in sums],
        *[F.lag(f"_l_{o}").over(before).alias(f"_c_{o}") for o in lags],
        *[F.last(f"_f_{o}", ignorenulls=True).over(earlier).alias(f"_c_{o}") for o in fills],
    )
    joined = null_safe_join(local, carried, slice_keys)
    out = [F.col(c) for c in df.columns]
    for o in sums:
        kind = local.schema[o].dataType
        zero = F.lit(0).cast(kind)
        both = F.coalesce(F.col(o), zero) + F.coalesce(F.col(f"_c_{o}"), zero)
        out.append(both.cast(kind).alias(o))
    for o, v in lags.items():
        carry = F.col(f"_c_{o}").getField(v)
        out.append(F.when(F.col("_pos") == 1, carry).otherwise(F.col(o)).alias(o))
    out += [F.coalesce(F.col(o), F.col(f"_c_{o}")).alias(o) for o in fills]
    return joined.select(*out)


def numbered(df: DataFrame, order: list[str], out: str = "row_index") -> DataFrame:
    """Zero-based position of each row in a total order, without a one-task sort."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return (
        running(one, [], order, sums={out: "_one"})
        .withColumn(out, F.col(out) - 1)
        .drop("_one")
    )


def percentiles(
    df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Exact linearly interpolated percentiles, one output column per entry of ``qs``.

    Spark's exact ``percentile`` keeps all distinct values of a group in one
    buffer. Here rows shrink to distinct values in range order; the slice sizes
    tell which slices hold the requested ranks, and only those are scanned.
    """
    by = by or []
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = ranged(counts, by, ["_v"])
    sizes = placed.groupBy("_slice", *by).agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_size").over(Window.partitionBy(*by))
    wanted = []
    for name, q in qs.items():
        at = F.lit(float(q)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            wanted.append(
                F.struct(
                    F.lit(f"{name}.{side}").alias("_what"), rank.cast("long").alias("_rank"),
                    (at - F.floor(at)).alias("_w"),
                )
            )
    targets = (
        sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn("_total", total)
        .select("_slice", *by, "_before", "_size", F.inline(F.array(*wanted)))
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size")))
        .drop("_size")
    )
    hit = null_safe_join(placed, targets, ["_slice", *by], "inner")
    inside = Window.partitionBy("_slice", *by, "_what").orderBy("_v")
    upto = F.col("_before") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    found = hit.withColumn("_upto", upto).where(
        (F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank"))
    )

    def of(name: str, side: str, col: str) -> Column:
        return F.max(F.when(F.col("_what") == f"{name}.{side}", F.col(col)))

    return found.groupBy(*by).agg(
        *[
            (
                of(n, "lo", "_v")
                + (of(n, "hi", "_v") - of(n, "lo", "_v")) * of(n, "lo", "_w")
            ).alias(n)
            for n in qs
        ]
    )
