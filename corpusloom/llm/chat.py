"""Chat formatting: schema fingerprints choose declarative mappings; one reversible template.

A layout is known by the hash of its sorted nested field paths, as `messages[].role`. Paths outside the known
vocabulary are left out of the hash, so extra columns do no harm. A table's fingerprint comes from its schema, a
JSON record's from its own keys and those of all its elements, row by row; either selects a mapping that gives canonical
turns (role, text). A table with one row a turn is a layout like the others: each row is a list of one turn, at its place.

The template writes each turn as <|turn|>role<|text|>text<|end|>. A control string inside a role or a text gets one
backslash after its first character (one more, if it has some): the text then holds no control string, and taking
one away gives it back. All of this is DataFrame functions.

Defined results: null roles and texts are empty; equal turn numbers follow in the order of role and text; rows of a
null conv_id are one conversation; a record of unknown layout has null turns; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = r"(\|[a-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>>)"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """One layout: its field paths, and SQL for its turns as an array of (role, text)."""

    name: str
    paths: tuple[str, ...]
    turns: str
    #: The column that numbers a row's turns from; none if a row is a whole conversation.
    first: str | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def _pairs(*fields: tuple[str, str]) -> str:
    made = ", ".join(f"named_struct('role', '{role}', 'text', {sql})" for role, sql in fields)
    return f"array({made})"


def _listed(name: str, role: str, text: str) -> str:
    named = f"CASE lower(m.{role}) WHEN 'human' THEN 'user' WHEN 'prompter' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE m.{role} END"
    return f"transform({name}, m -> named_struct('role', {named}, 'text', m.{text}))"


_WITH_INPUT = "concat_ws('\\n\\n', instruction, nullif(input, ''))"
_SYSTEM = "filter(array(named_struct('role', 'system', 'text', system)), m -> m.text <> '')"
TURN_ROWS = Mapping("turn_rows", ("conv_id", "turn", "role", "text"), "array(named_struct('role', role, 'text', text))", "turn")
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), _listed("messages", "role", "content")),
    Mapping("sharegpt", ("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
    Mapping("sharegpt_system", ("conversations[].from", "conversations[].value", "system"), f"concat({_SYSTEM}, {_listed('conversations', 'from', 'value')})"),
    Mapping("conversation_roles", ("conversations[].role", "conversations[].content"), _listed("conversations", "role", "content")),
    Mapping("prompt_response", ("prompt", "response"), _pairs(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), _pairs(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("instruction", "output"), _pairs(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("instruction", "input", "output"), _pairs(("user", _WITH_INPUT), ("assistant", "output"))),
    Mapping("inputs_targets", ("inputs", "targets"), _pairs(("user", "inputs"), ("assistant", "targets"))),
    Mapping("question_answer", ("question", "answer"), _pairs(("user", "question"), ("assistant", "answer"))),
)
_LISTS = ("messages", "conversations")
_KNOWN = frozenset(p for m in MAPPINGS for p in m.paths)
_RECORD = "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string,role:string,content:string>>, system string, prompt string, response string, completion string, instruction string, input string, output string, inputs string, targets string, question string, answer string"


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves of a schema; [] stands for the elements of an array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return [at]


def mapping_of(schema: T.StructType) -> Mapping:
    """The mapping that the fingerprint of a table's schema selects; an unknown layout raises ValueError."""
    paths = set(field_paths(schema))
    # conv_id and turn number rows in any layout, so they only tell turn rows.
    by = {fingerprint(paths & set(TURN_ROWS.paths)): [TURN_ROWS], fingerprint(paths & _KNOWN): MAPPINGS}
    found = [m for own, some in by.items() for m in some if m.fingerprint == own]
    if not found:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    return found[0]


def turn_rows(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Canonical rows (conv_id, turn, role, text) of a table of any known layout."""
    mapping = mapping_of(df.schema)
    at = F.col(mapping.first) if mapping.first else F.lit(0)
    named = df.select(F.col(conv_id).alias("conv_id"), at.cast("long").alias("_first"), F.posexplode(F.expr(mapping.turns)).alias("_pos", "m"))
    return named.select("conv_id", (F.col("_first") + F.col("_pos")).alias("turn"), "m.role", "m.text")


def record_layout(json: str = "json") -> Column:
    """The name of the layout of each JSON record, by its own fingerprint; null if unknown."""
    top = F.expr(f"coalesce(json_object_keys({json}), cast(array() as array<string>))")
    # Elements may have different keys; a field's path is there if any element has it.
    each = "coalesce(flatten(transform(from_json({json}, '{x} array<string>').{x}, e -> coalesce(json_object_keys(e), cast(array() as array<string>)))), cast(array() as array<string>))"
    nested = [F.expr(f"transform({each.format(json=json, x=x)}, k -> concat('{x}[].', k))") for x in _LISTS]
    paths = F.array_intersect(F.concat(top, *nested), F.array(*map(F.lit, sorted(_KNOWN))))
    own = F.sha2(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"), 256)
    names = F.create_map(*[F.lit(x) for m in MAPPINGS for x in (m.fingerprint, m.name)])
    return F.try_element_at(names, own)


def record_turns(df: DataFrame, json: str = "json") -> DataFrame:
    """df with layout and turns of each JSON record, whatever layouts are mixed in it."""
    kept = [c for c in df.columns if c not in ("layout", "turns", "_r")]
    parsed = df.select(*kept, record_layout(json).alias("layout"), F.from_json(json, _RECORD).alias("_r"))
    turns = F.lit(None).cast(_TURNS)
    for m in MAPPINGS:
        turns = F.when(F.col("layout") == m.name, F.expr(_under(m.turns)).cast(_TURNS)).otherwise(turns)
    return parsed.withColumn("turns", turns).drop("_r")


def _under(sql: str) -> str:
    """The mapping's SQL with its fields taken from the parsed record _r."""
    names = [f.name for f in T._parse_datatype_string(_RECORD).fields]
    return re.sub(rf"(?<![.'\w])({'|'.join(names)})(?=[,)])", r"_r.\1", sql)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_spans, the spans (begin, end) in code points of assistant texts."""
    role, text = (escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), role.alias("_role"), text.alias("_text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "_text")
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_head", F.concat(F.lit(TURN), "_role", F.lit(TEXT)))
    size = F.length("_head") + F.length("_text") + F.lit(len(END))
    rows = rows.withColumn("_end", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.lit(len(END)))
    item = F.struct("_n", F.concat("_head", "_text", F.lit(END)).alias("out"), (F.col("_end") - F.length("_text")).alias("begin"), F.col("_end").alias("end"), (F.col("role") == "assistant").alias("loss"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    spans = F.expr("transform(filter(t, x -> x.loss), x -> named_struct('begin', x.begin, 'end', x.end))")
    return lists.select("conv_id", F.array_join(F.expr("transform(t, x -> x.out)"), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: str = "formatted") -> Column:
    """The turns (role, text) of a formatted conversation."""
    each = F.expr(f"slice(split({formatted}, '<[|]end[|]>', -1), 1, size(split({formatted}, '<[|]end[|]>', -1)) - 1)")
    return F.transform(
        each,
        lambda x: F.struct(
            unescaped(F.substring_index(F.substring(x, F.lit(len(TURN) + 1), F.length(x)), TEXT, 1)).alias("role"),
            unescaped(F.substring(x, F.instr(x, TEXT) + F.lit(len(TEXT)), F.length(x))).alias("text"),
        ),
    )


def under_mask(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(F.col(formatted), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    done = formatted(turn_rows(table(spark, sf_dir, "conversations")).unionByName(turn_rows(own)))
    done = done.withColumn("turns", read_back()).withColumn("loss", under_mask())
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(\|[a-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g')"
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 cast(sum(length({_SQL_ESCAPED.format('role')}) + length({_SQL_ESCAPED.format('text')}) + {len(TURN + TEXT + END)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
