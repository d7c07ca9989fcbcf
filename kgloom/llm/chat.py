"""Chat formatting: tool calls linked with their results.

Calls and results are joined by (conversation, call id).  Calls are ordered topologically: a call's level is one more
than the highest level among the calls it depends on.  Every call first follows one of its dependencies, the latest;
pointer doubling then finds all levels in a logarithmic number of rounds however long the chains are, and calls that
have a higher dependency than the one they follow are turned to it, until none has.  Arguments are validated against
the schema of the called tool, and each linked call is serialised as canonical JSON.
"""

from __future__ import annotations

import contextlib
import decimal
import json
import math
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The schemas are part of the task's code: at most this many bytes as JSON.
SCHEMA_BYTES = 1_000_000

#: Arguments that are nested deeper are kept as text.
DEPTH = 200

_KINDS = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}
_LONE = re.compile("[\ud800-\udfff]")


def _finite(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError("beyond a double")
    return value


def _refuse(name: str) -> object:
    raise ValueError(f"{name} isn't JSON")


@contextlib.contextmanager
def _long_integers() -> Iterator[None]:
    """Integers of any number of digits may be read and written."""
    before = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    try:
        yield
    finally:
        sys.set_int_max_str_digits(before)


def parse(text: str) -> object:
    """The value of a JSON text; ValueError if it is none, holds a number beyond a double's range, or is too deep.

    Of repeated keys the last counts.  Integers keep all their digits.
    """
    try:
        with _long_integers():
            value = json.loads(text, parse_float=_finite, parse_constant=_refuse)
    except RecursionError:
        raise ValueError("too deep") from None
    level = [value]
    for _ in range(DEPTH):
        level = [x for v in level if isinstance(v, dict | list) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return value
    raise ValueError("too deep")


def _number(value: float) -> str:
    """The shortest digits that give this double, as JavaScript writes them."""
    if value == 0:
        return "0"
    sign, digits, exponent = decimal.Decimal(repr(value)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exponent
    if len(text) <= point <= 21:
        text = text + "0" * (point - len(text))
    elif 0 < point <= 21:
        text = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        text = f"0.{'0' * -point}{text}"
    else:
        text = f"{text[0]}{'.' if text[1:] else ''}{text[1:]}e{point - 1:+d}"
    return f"-{text}" if sign else text


def _written(value: object) -> str:
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_written(k)}:{_written(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    return _number(value) if isinstance(value, float) else json.dumps(value)


def plain(text: str) -> str:
    """Lone surrogates, which UTF-8 can't hold, as escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    """JSON with keys sorted by code point, no spaces, shortest numbers (1 for 1.0) and characters as they are; only
    quotes, backslashes, control characters and lone surrogates are escaped."""
    with _long_integers():
        return plain(_written(value))


def problems(value: object, schema: dict, path: str = "$") -> list[str]:
    """What is wrong with ``value`` by the JSON Schema words type, enum, minimum, maximum, minLength, required,
    properties, additionalProperties (a boolean) and items."""
    kinds = schema.get("type")
    if kinds is not None and not any(_KINDS[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{path}: not {kinds}"]
    found = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        found.append(f"{path}: not in enum")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            found.append(f"{path}: out of range")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        found.append(f"{path}: too short")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{path}.{plain(k)}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems(value[k], known[k], f"{path}.{plain(k)}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{path}.{plain(k)}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += problems(x, schema["items"], f"{path}[{i}]")
    return found


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of all calls that aren't on or behind a cycle."""
    key = ["conv_id", "call_id"]
    names = materialise(calls.groupBy(*key).agg(F.max("position").alias("at")), "names")
    needs = calls.select(*key, F.explode("after").alias("before")).distinct()
    needs = materialise(needs.join(names.select("conv_id", F.col("call_id").alias("before"), "at"), ["conv_id", "before"]), "needs")
    follows = needs.groupBy(*key).agg(F.max(F.struct("at", "before")).alias("x")).select(*key, F.col("x.before").alias("up"))
    while True:
        levels = _doubled(materialise(names.join(follows, key, "left").select(*key, "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("level")), "follows"))
        # A null level is that of a cycle, above all others.
        known = levels.select("conv_id", F.col("call_id").alias("before"), F.coalesce("level", F.lit(2**31 - 2)).alias("below"))
        best = materialise(needs.join(known, ["conv_id", "before"]).groupBy(*key).agg(F.max(F.struct("below", "at", "before")).alias("x")).select(*key, "x.below", F.col("x.before").alias("up")), "highest")
        if best.join(levels, key).where("level is not null and below >= level").isEmpty():
            return levels.where("level is not null")
        follows = best.select(*key, "up")


def _doubled(state: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls that each follow at most one other (up); null where that leads into a cycle."""
    open_ = -1
    while (left := state.where("up is not null").count()) not in (0, open_):
        # In a forest some call gets to its root in every round, so what no longer shrinks runs in circles.
        open_ = left
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        moved = state.join(above, ["conv_id", "up"], "left")
        state = materialise(moved.select("conv_id", "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "doubled")
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).cast("int").alias("level"))


def _serialise(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, texts = [], []
            for row in batch.to_pylist():
                out = {"call_id": row["call_id"], "name": row["name"], "level": row["level"], "status": row["status"], "result": row["content"]}
                found = []
                if row["status"] != "orphan":
                    try:
                        out["arguments"] = value = parse("null" if row["arguments"] is None else row["arguments"])
                        found = problems(value, schemas[row["name"]]) if row["name"] in schemas else [f"$: no schema of {row['name']}"]
                    except ValueError as error:
                        out["arguments"], found = row["arguments"], ["$: too deep" if str(error) == "too deep" else "$: not JSON"]
                errors.append(found)
                texts.append(canonical(out))
            kept = ["conv_id", "call_id", "position", "level", "status", "n_results"]
            yield pa.record_batch([*[batch[n] for n in kept], pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())], [*kept, "errors", "json"])

    return run


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row for each call, and for each result id that no call has.

    ``calls`` (conv_id, call_id string, position long, name, arguments JSON string, after array of call ids) and
    ``results`` (conv_id, call_id string, content string).  Returns conv_id, call_id, position, level, status,
    n_results, errors and json.

    status: ``linked``; ``unanswered`` (a call without a result); ``cycle`` (a call on or behind a cycle of
    dependencies, with a null level); ``orphan`` (results without a call, with null position and level).  Rows with a
    null conversation or call id are never linked: such calls are unanswered, such results orphans.  Of several
    results of one id the smallest content counts, ``n_results`` tells how many there were.  Repeated calls are
    linked one by one and share a level.  Dependencies on unknown calls are ignored; a null list is empty.  Arguments
    that are null count as JSON null; those that are empty, not JSON, hold a number beyond a double's range or are
    nested more than 200 levels deep are kept as text, with an error.  Ordering by (level, position) within a conversation is a topological order.
    Empty tables are allowed, other columns are not read.
    """
    assert len(json.dumps(schemas)) <= SCHEMA_BYTES
    kind = calls.schema["conv_id"].dataType.simpleString()
    calls = materialise(calls.select("conv_id", "call_id", F.col("position").cast("long").alias("position"), "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after")), "calls")
    named = calls.where("conv_id is not null and call_id is not null")
    levels = _levels(named)
    answers = results.groupBy("conv_id", "call_id").agg(F.min("content").alias("content"), F.count("*").cast("long").alias("n_results"))
    ordered = calls.drop("after").join(levels, ["conv_id", "call_id"], "left").withColumn("is_call", F.lit(True))
    joined = ordered.join(answers, ["conv_id", "call_id"], "full_outer")
    lone = F.col("conv_id").isNull() | F.col("call_id").isNull()
    status = F.when(F.col("is_call").isNull(), "orphan").when(F.col("level").isNull() & ~lone, "cycle").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    rows = joined.select("conv_id", "call_id", "position", F.when(lone & F.col("is_call"), F.lit(0)).otherwise(F.col("level")).alias("level"), status.alias("status"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "name", "arguments", "content")
    schema = f"conv_id {kind}, call_id string, position long, level int, status string, n_results long, errors array<string>, json string"
    return rows.mapInArrow(_serialise(schemas), schema)
