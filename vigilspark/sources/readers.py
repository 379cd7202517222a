"""Scans: logs by type, files by format, search responses, source groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import coerce_numeric

# How each log type is laid out.
TAB_LOGS = ("ssh", "dns", "dhcp")
PROXY_LOGS = ("proxy", "bluecoat")
TEXT_SUFFIXES = ("csv", "log")
FORMATS = ("parquet", "json", "csv")


def log_options(log_type: str) -> dict[str, str]:
    """CSV options of a log type."""
    if log_type in TAB_LOGS:
        return {"sep": "\t", "header": "false", "encoding": "UTF-8"}
    if log_type in PROXY_LOGS:
        return {"sep": " ", "header": "true", "encoding": "ISO-8859-1"}
    return {"sep": " ", "header": "true", "encoding": "UTF-8"}


def suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def _decoded(name: str) -> Column:
    """Text read as Latin-1, decoded as UTF-8 where its bytes are valid UTF-8."""
    text = F.encode(F.col(name), "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.col(name)).alias(name)


def read_log(
    spark: SparkSession, path: str, log_type: str, tolerant: bool = False,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A log file or folder laid out as its type demands.

    Without a schema Spark infers types, which reads the text twice; pass one for
    large logs. ``tolerant`` drops malformed lines, which needs the schema to
    tell what is malformed, and keeps values that are not UTF-8 as Latin-1; both
    happen in the one pass over the text.
    """
    ending = suffix(path)
    if ending in ("parquet", "json"):
        return read_data(spark, path, ending)
    if ending and ending not in TEXT_SUFFIXES:
        raise ValueError(f"unknown log suffix {ending!r}")
    options = log_options(log_type)
    reader = spark.read
    if tolerant:
        if schema is None:
            raise ValueError("a tolerant read needs a schema")
        mixed = options["encoding"] == "UTF-8"
        options["encoding"] = "ISO-8859-1"
        # Without pruning a line is judged on all its columns, whatever is selected.
        options |= {"mode": "DROPMALFORMED", "columnPruning": "false"}
    if not ending:
        reader = reader.option("pathGlobFilter", "*.{csv,log}")
    reader = reader.options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    df = reader.csv(path)
    if tolerant and mixed:
        texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
        df = df.select(*[_decoded(c) if c in texts else F.col(c) for c in df.columns])
    return df


def read_data(spark: SparkSession, path: str, format: str, **options) -> DataFrame:
    """Parquet, JSON or CSV by name; another format is an error. CSV has a header unless told otherwise."""
    if format not in FORMATS:
        raise ValueError(f"unsupported format {format!r}")
    schema = options.pop("schema", None)
    if format == "csv":
        options = {"header": "true", **options}
        if schema is None:
            options.setdefault("inferSchema", "true")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(format).load(path)


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Format by suffix, CSV when it says nothing."""
    ending = suffix(path)
    return read_data(spark, path, ending if ending in FORMATS else "csv", **options)


def read_hits(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, coerce: bool = True,
    lines: bool = False,
) -> DataFrame:
    """Documents of search-response dumps (``hits.hits[]._source``), one row each.

    A response file is one JSON value and therefore one task; ``lines`` reads
    dumps with one response per line, which Spark can split. Mostly numeric text
    columns become numbers.
    """
    reader = spark.read.option("multiLine", str(not lines).lower())
    if schema is not None:
        reader = reader.schema(schema)
    documents = reader.json(path).select(F.explode("hits.hits").alias("_h")).select("_h._source.*")
    return coerce_numeric(documents) if coerce else documents


def load_source(spark: SparkSession, root: str, source: dict) -> DataFrame:
    """One configured log source below a group's folder."""
    kind = source.get("type")
    path = f"{root.rstrip('/')}/{source.get('folder', '')}".rstrip("/")
    if kind not in FORMATS:
        raise ValueError(f"unsupported source type {kind!r}")
    options = {}
    if kind == "csv":
        options = {"sep": source.get("delimiter", " ")}
    return read_data(spark, path, kind, **options)


def load_group(
    spark: SparkSession, group: dict, log_name: str | None = None
) -> DataFrame | dict[str, DataFrame]:
    """All sources of a group by name, or the named one. One failure fails the load."""
    sources = group.get("data") or []
    root = group.get("folder", "")
    if log_name is not None:
        for source in sources:
            if source.get("log_name") == log_name:
                return load_source(spark, root, source)
        raise ValueError(f"no log {log_name!r} in the group")
    return {
        source.get("log_name") or f"source_{i}": load_source(spark, root, source)
        for i, source in enumerate(sources)
    }


_SOURCE = (
    "log_name: STRING, type: STRING, delimiter: STRING, location_type: STRING, folder: STRING, "
    "id_feature: STRING"
)


def flatten_source_groups(
    spark: SparkSession, path: str, known: DataFrame | None = None, lines: bool = False
) -> DataFrame:
    """One row per configured source; groups whose ``slug`` is known are skipped."""
    layout = f"source_groups ARRAY<STRUCT<source_group_name: STRING, mode: STRING, data: ARRAY<STRUCT<{_SOURCE}>>>>"
    groups = (
        spark.read.schema(layout).option("multiLine", str(not lines).lower()).json(path)
        .select(F.explode("source_groups").alias("g"))
        .where(F.col("g.source_group_name") != "")
        .select(F.col("g.source_group_name").alias("slug"), "g.mode", F.explode_outer("g.data").alias("s"))
        .select("slug", "mode", "s.*")
    )
    return groups.join(known.select("slug"), "slug", "left_anti") if known is not None else groups


def flatten_model_groups(
    spark: SparkSession, path: str, known: DataFrame | None = None, lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(models, components) of a model configuration; models with a known name are skipped.

    Of several models of one name, the first listed counts. A configuration of any size is read
    with ``lines``: one JSON object of groups a line, read by as many tasks as the file has splits;
    the first one of a name is then that of the least place in its line, then of the least group.
    """
    component = "STRUCT<filename: STRING, type: STRING, file_hash: STRING, data_hash: STRING>"
    model = (
        "STRUCT<model_name: STRING, description: STRING, enabled: BOOLEAN, runtime: STRING, "
        f"components: ARRAY<{component}>>"
    )
    text = spark.read.text(path, wholetext=not lines)
    rows = (
        text.select(F.posexplode(F.from_json("value", f"MAP<STRING, STRUCT<models: ARRAY<{model}>>>")).alias("_g", "grp", "m"))
        .select("_g", "grp", F.posexplode("m.models").alias("_p", "m"))
        .select(F.col("m.model_name").alias("name"), F.struct("_g", "_p", F.col("grp").alias("model_group"), "m").alias("_row"))
        .groupBy("name").agg(F.min("_row").alias("_row"))
        .select("name", "_row.model_group", "_row.m")
    )
    if known is not None:
        rows = rows.join(known.select("name"), "name", "left_anti")
    models = rows.select(
        "name", "model_group", F.lit("1.0.0").alias("version"),
        F.coalesce("m.description", F.lit("")).alias("description"),
        F.when(F.coalesce("m.enabled", F.lit(False)), "installed").otherwise("disabled").alias("status"),
        F.coalesce("m.enabled", F.lit(True)).alias("enabled"),
        F.coalesce("m.runtime", F.lit("python-base")).alias("runtime"),
    )
    parts = rows.select("name", F.explode("m.components").alias("c")).select(
        "name", F.col("c.filename").alias("filename"),
        F.coalesce("c.type", F.lit("external")).alias("component_type"),
        F.coalesce("c.file_hash", F.lit("")).alias("file_hash"), F.col("c.data_hash").alias("data_hash"),
    )
    return models, parts
