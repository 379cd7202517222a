"""Column expressions: all built from Spark functions, so they stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (lower bound, label) per severity scale, highest first. Scale
# "trend" uses a strict bound, the other two an inclusive one.
SCALES = {
    "trend": (False, ((80, "critical"), (50, "high"), (20, "medium"))),
    "entity": (True, ((80, "critical"), (50, "high"), (20, "medium"))),
    "anomaly": (True, ((80, "high"), (50, "medium"))),
}


def severity(risk: Column, scale: str) -> Column:
    """Severity label of a risk score; a null score counts as zero."""
    inclusive, bounds = SCALES[scale]
    value = F.coalesce(risk, F.lit(0.0))
    label = F
    for bound, name in bounds:
        label = label.when(value >= bound if inclusive else value > bound, name)
    return label.otherwise("low")


def severity_labels(scale: str) -> list[str]:
    return [name for _, name in SCALES[scale][1]] + ["low"]


def half_up(value: Column) -> Column:
    """Round half towards plus infinity, as a browser does."""
    return F.floor(value + 0.5)


def round6(value: Column) -> Column:
    """Six decimals, so that sums taken in another row order still compare equal."""
    return F.floor(value * 1e6 + 0.5) / 1e6


def slugify(text: Column) -> Column:
    return F.translate(F.lower(text), " _", "--")


def age_label(ts: Column, as_of: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 60)
    hours = F.floor(minutes / 60)
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
    )


def compare(value: Column, op: str, threshold: Column | float) -> Column:
    """Six numeric operators; any other operator is false."""
    other = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    known = {
        ">": value > other,
        "<": value < other,
        ">=": value >= other,
        "<=": value <= other,
        "==": value == other,
        "!=": value != other,
    }
    return known.get(op, F.lit(False))


def compare_by(value: Column, op: Column, threshold: Column) -> Column:
    """``compare`` with the operator held in a column."""
    result = F
    for name in (">", "<", ">=", "<=", "==", "!="):
        result = result.when(op == name, compare(value, name, threshold))
    return result.otherwise(F.lit(False))


def contains_ci(text: Column, needle: str) -> Column:
    """Case-insensitive substring test without wildcard meaning."""
    return F.lower(text).contains(needle.lower())


def split_record(text: Column, sep: str) -> Column:
    """Split on a literal separator."""
    return F.split(text, r"\Q" + sep + r"\E", -1)


def sha256(payload: Column) -> Column:
    return F.sha2(payload, 256)


def b64(text: Column) -> Column:
    # Spark breaks the code into lines of 76 characters.
    return F.translate(F.base64(text), "\r\n", "")


def unb64(text: Column) -> Column:
    return F.unbase64(text).cast("string")


def align_dim(features: Column, n: int) -> Column:
    """Truncate or zero-pad a feature array to ``n`` entries."""
    return F.slice(F.concat(features, F.array_repeat(F.lit(0.0), n)), 1, n)


def truthy(value: Column, kind: str) -> Column:
    """Truth value of a node result whose static kind is known."""
    if kind == "bool":
        return F.coalesce(value, F.lit(False))
    if kind == "number":
        return F.coalesce(value != 0.0, F.lit(False))
    return F.lit(False)


def log_level(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(low.contains("error") | low.contains("exception"), "error")
        .when(low.contains("warn"), "warning")
        .otherwise("info")
    )


def parse_logs(
    lines: DataFrame, component: str, line: str = "value", newest: int | None = None, message_chars: int | None = 200
) -> DataFrame:
    """Lines of ``<timestamp> <message>`` to log rows; lines without a message are skipped.

    ``message_chars`` is the length that the log view shows (None: all of it), and
    ``newest`` asks for the latest rows only, newest first.
    """
    text = F.col(line)
    at = F.instr(text, " ")
    stamp = F.substring(text, F.lit(1), at - 1)
    message = F.substring(text, at + 1, F.length(text))
    rows = lines.where(at > 0).select(
        F.concat(F.lit(component + "_"), stamp).alias("id"),
        stamp.alias("timestamp"),
        F.lit(component).alias("component"),
        log_level(message).alias("level"),
        (F.substring(message, 1, message_chars) if message_chars else message).alias("message"),
    )
    if newest is None:
        return rows
    return rows.orderBy(F.desc("timestamp"), "id", "message").limit(newest)


def split_lines(docs: DataFrame, text: str) -> DataFrame:
    """One row per line of a text column, named ``value``."""
    return docs.select(F.explode(F.split(F.col(text), r"\r\n|\n|\r")).alias("value"))
