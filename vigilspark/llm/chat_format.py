"""Chat formatting: heterogeneous records become canonical turns, then one marked text.

Which mapping reads a record is decided by a fingerprint: the hash of those of its
nested field paths that some mapping names, so further fields do not matter. JSON
records are fingerprinted row by row from their variant value, tables once from their
own schema. Everything is DataFrame functions.

A turn is written ``<|start|>role<|text|>text<|end|>``. In roles and texts
``&`` becomes ``&amp;`` and the first letter of each control string an entity,
so control strings never occur there and undoing the entities is exact.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Strings that mark something in this or another common template.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ENTITIES = [("&lt;", "<"), ("&#91;", "["), ("&amp;", "&")]
LOSS_ROLES = ("assistant",)

# The common names of speakers and of fields in public chat data; fixed values.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user"}
#: Layout -> nested fields and how they become turns: (list, role field, text field) or [(role, field), ...].
LAYOUTS = {
    "messages": ({"messages": [{"role": 0, "content": 0}]}, ("messages", "role", "content")),
    "conversations": ({"conversations": [{"from": 0, "value": 0}]}, ("conversations", "from", "value")),
    "turns": ({"turns": [{"role": 0, "text": 0}]}, ("turns", "role", "text")),
    "prompt_response": ({"prompt": 0, "response": 0}, [("user", "prompt"), ("assistant", "response")]),
    "prompt_completion": ({"prompt": 0, "completion": 0}, [("user", "prompt"), ("assistant", "completion")]),
    "system_prompt_response": ({"system": 0, "prompt": 0, "response": 0},
                               [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    "question_answer": ({"question": 0, "answer": 0}, [("user", "question"), ("assistant", "answer")]),
    "instruction_output": ({"instruction": 0, "output": 0}, [("user", "instruction"), ("assistant", "output")]),
    "instruction_input_output": ({"instruction": 0, "input": 0, "output": 0},
                                 [("user", "instruction"), ("user", "input"), ("assistant", "output")]),
}
#: Table layout -> columns of conversation, order, role and text, or of conversation and [(role, column), ...].
TABLE_LAYOUTS = {
    "turn_rows": ("conv_id", "turn", "role", "text"),
    "message_rows": ("conversation_id", "message_index", "role", "content"),
    "speaker_rows": ("conversation_id", "turn", "from", "value"),
    "prompt_response_rows": ("id", [("user", "prompt"), ("assistant", "response")]),
    "system_prompt_response_rows": ("id", [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    "instruction_output_rows": ("id", [("user", "instruction"), ("assistant", "output")]),
}
#: Plain values in the text of a variant's schema.
_PLAIN = r"(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+, ?\d+\))"


def paths(fields: dict) -> list[str]:
    """Nested field paths of a layout, sorted."""
    out = []
    for name, inner in fields.items():
        out.append(name)
        if isinstance(inner, list):
            out += [f"{name}[].{x}" for x in inner[0]]
    return sorted(out)


#: All paths that some mapping names; the others do not enter a fingerprint.
NAMED = sorted({p for fields, _ in LAYOUTS.values() for p in paths(fields)})


def fingerprint(fields: dict | list[str]) -> str:
    names = paths(fields) if isinstance(fields, dict) else sorted(fields)
    return hashlib.sha256("\n".join(names).encode()).hexdigest()


def named_paths(record: Column) -> Column:
    """Those named paths that a JSON record has, sorted; null when it cannot be read.

    A field counts if its value is plain, a list if some element has such a field.
    """
    value = F.try_parse_json(record)
    lists = {p.partition("[].")[0] for p in NAMED if "[]." in p}
    found = []
    for path in NAMED:
        top, _, field = path.partition("[].")
        kind = F.schema_of_variant(F.try_variant_get(value, f"$.{top}", "variant"))
        wanted = rf"^ARRAY<OBJECT<(?:.*, )?{field}: {_PLAIN}[,>]" if field else "^ARRAY<OBJECT<" if top in lists else f"^{_PLAIN}$"
        found.append(F.when(kind.rlike(wanted), F.lit(path)))
    return F.when(value.isNotNull(), F.array_compact(F.array(*found)))


def json_fingerprint(record: Column) -> Column:
    """Fingerprint of each JSON record; null when it cannot be read."""
    return F.sha2(F.array_join(named_paths(record), "\n"), 256)


def escape(text: Column) -> Column:
    entity = {letter: name for name, letter in ENTITIES}
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(entity[control[0]] + control[1:]))
    return out


def unescape(text: Column) -> Column:
    for name, letter in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(letter))
    return text


TURN = "array<struct<role:string,text:string>>"


def _turns(record: Column, layout: str) -> Column:
    fields, rule = LAYOUTS[layout]
    if isinstance(rule, tuple):
        items, role, text = rule
        parsed = F.from_json(record, f"`{items}` array<struct<`{role}`:string,`{text}`:string>>")
        speaker = lambda t: F.coalesce(F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv])[t[role]], t[role])
        name = (lambda t: t[role]) if layout == "turns" else speaker
        return F.transform(parsed[items], lambda t: F.struct(name(t).alias("role"), t[text].alias("text")))
    parsed = F.from_json(record, ", ".join(f"`{f}` string" for _, f in rule))
    return F.array(*[F.struct(F.lit(r).alias("role"), parsed[f].alias("text")) for r, f in rule])


def turns_from_json(records: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """``conv_id, turn, role, text, layout``: one row per turn of each readable record.

    The fingerprint selects the mapping, and further fields do not change it; a record that has
    the paths of several mappings at once is read by the one with the most. Records of no known
    layout (or broken, null) give one row with null ``layout``, ``turn``, ``role`` and ``text``,
    so none is lost.
    """
    found = records.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(record).alias("_r"), named_paths(F.col(record)).alias("_p"))
    read = found.withColumn("_f", F.sha2(F.array_join("_p", "\n"), 256))
    # Without a mapping of just these paths, the one with the most fields of which none is missing.
    layout = F.lit(None).cast("string")
    for name, (fields, _) in sorted(LAYOUTS.items(), key=lambda kv: len(paths(kv[1][0]))):
        layout = F.when(F.size(F.array_except(F.array(*map(F.lit, paths(fields))), F.col("_p"))) == 0, F.lit(name)).otherwise(layout)
    for name, (fields, _) in LAYOUTS.items():
        layout = F.when(F.col("_f") == fingerprint(fields), F.lit(name)).otherwise(layout)
    read = read.select("conv_id", "_r", layout.alias("_layout"))
    layout, turns = F.col("_layout"), F.lit(None).cast(TURN)
    for name in LAYOUTS:
        turns = F.when(layout == name, _turns(F.col("_r"), name).cast(TURN)).otherwise(turns)
    named = read.select("conv_id", layout.alias("layout"), turns.alias("_t"))
    return named.select("conv_id", "layout", F.posexplode_outer("_t").alias("turn", "_t")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "_t.role", "_t.text", "layout"
    )


def table_layout(table: DataFrame) -> str:
    """The table layout that the fingerprint of the table's named columns selects."""

    def columns(name: str) -> list[str]:
        first, *rest = TABLE_LAYOUTS[name]
        return [first, *([c for _, c in rest[0]] if isinstance(rest[0], list) else rest)]

    named = {c for name in TABLE_LAYOUTS for c in columns(name)}
    held = [f.name for f in table.schema if f.name in named and isinstance(f.dataType, (T.AtomicType, T.NullType))]
    prints = {fingerprint(columns(name)): name for name in TABLE_LAYOUTS}
    if fingerprint(held) in prints:
        return prints[fingerprint(held)]
    # As with records: the most fields, none missing; the first of equally many.
    able = [name for name in TABLE_LAYOUTS if set(columns(name)) <= set(held)]
    if not able:
        raise ValueError(f"no known layout has the fields {sorted(table.columns)}")
    return max(able, key=lambda name: len(columns(name)))


def turns_from_table(table: DataFrame) -> DataFrame:
    """The same columns from a table of turns, or of one conversation a row, by its layout; other columns are ignored."""
    layout = table_layout(table)
    conv, *rest = TABLE_LAYOUTS[layout]
    if isinstance(rest[0], list):
        said = F.array(*[F.struct(F.lit(role).alias("role"), F.col(f"`{c}`").cast("string").alias("text")) for role, c in rest[0]])
        rows = table.select(F.col(conv).cast("long").alias("conv_id"), F.posexplode(said).alias("turn", "_t"))
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "_t.role", "_t.text", F.lit("turn_rows").alias("layout"))
    turn, role, text = rest
    name = F.col(f"`{role}`").cast("string")
    if role == "from":
        name = F.coalesce(F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv])[name], name)
    return table.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), name.alias("role"),
                        F.col(text).cast("string").alias("text"), F.lit("turn_rows").alias("layout"))


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of each conversation.

    Turns are ordered by ``turn``, then role and text; null role or text is an empty
    one; repeated rows stay; rows without a layout add no turn. ``loss_spans`` are
    [begin, end) in code points of ``formatted``. A null ``conv_id`` is a conversation
    of its own; an empty table gives none. One conversation is one output value, so
    its turns meet in one task; offsets are running sums, not rebuilt lists.
    """
    clean = turns.select("conv_id", "turn", "layout", F.coalesce("role", F.lit("")).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"))
    has_turn = F.col("layout").isNotNull() & F.col("turn").isNotNull() | (F.col("layout") == "turn_rows")
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    pieces = clean.select("conv_id", "turn", "role", "text", has_turn.alias("_has"), head.alias("_head"), body.alias("_body"))
    pieces = pieces.withColumn("_piece", F.when(F.col("_has"), F.concat("_head", "_body", F.lit(END))).otherwise(F.lit("")))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.sum(F.length("_piece")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.length("_piece") + F.length("_head")
    placed = pieces.select(
        "conv_id", F.row_number().over(order).alias("_i"), "_piece", at.cast("long").alias("_at"),
        F.length("_body").cast("long").alias("_n"), (F.col("_has") & F.col("role").isin(*loss_roles)).alias("_loss"),
    )
    rows = F.array_sort(F.collect_list(F.struct("_i", "_piece", "_at", "_n", "_loss")))
    grouped = placed.groupBy("conv_id").agg(rows.alias("_t"))
    spans = F.transform(F.filter("_t", lambda t: t["_loss"]),
                        lambda t: F.struct(t["_at"].alias("begin"), (t["_at"] + t["_n"]).alias("end")))
    return grouped.select("conv_id", F.array_join(F.col("_t._piece"), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds, roles and texts as they were."""
    parts = F.filter(F.split(formatted, r"<\|start\|>"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.split_part(p, F.lit(TEXT), F.lit(1))).alias("role"),
        unescape(F.split_part(F.split_part(p, F.lit(TEXT), F.lit(2)), F.lit(END), F.lit(1))).alias("text"),
    ))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, joined without anything between."""
    cut = lambda s: unescape(F.substring(formatted, s["begin"].cast("int") + 1, (s["end"] - s["begin"]).cast("int")))
    return F.array_join(F.transform(spans, cut), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and SHA-256 digests."""
    read = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
                            read_turns(F.col("formatted")).alias("_t"),
                            loss_text(F.col("formatted"), F.col("loss_spans")).alias("_loss"))
    said = F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("_t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                       "formatted_chars")


def sample_record(spark: SparkSession) -> DataFrame:
    """Conversation -7, a JSON record whose texts hold control strings."""
    says = "</s>[INST] ok [/INST]"
    return spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(says).alias("content"))
                                     for r in ("user", "assistant")]).alias("messages"))).alias("record"),
    )


def _escape_sql(x: str) -> str:
    entity = {letter: name for name, letter in ENTITIES}
    x = f"replace({x}, '&', '&amp;')"
    for control in CONTROL:
        x = f"replace({x}, '{control}', '{entity[control[0]] + control[1:]}')"
    return x


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum({len(START + TEXT + END)} + length({_escape_sql('role')}) + length({_escape_sql('text')})) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""
