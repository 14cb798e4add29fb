"""Tool calls in assistant text: parse, coerce, classify, serialize.

A call is ``<tool_call><function=NAME><parameter=KEY>value</parameter>...</function></tool_call>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellium.functions import python_calls
from trellium.functions.arrays import bound

BLOCK = r"(?s)<tool_call>(.*?)</tool_call>"
FUNCTION = r"(?s)<function=([^\s>]+)>(.*?)</function>"
PARAMETER = r"(?s)<parameter=([^\s>]+)>(.*?)</parameter>"
CALLS = "array<struct<name:string,arguments:map<string,string>>>"
#: The closing marks of a turn, the mark of a failed task, and public methods that are no tools.
DONE_WORDS = ("task_finished", "task finished", "task completed", "finish")
ERROR_WORD = "task_error"
RESERVED = ("reset", "step", "close", "render", "seed", "state", "get_state", "get_state_info", "final_state", "initial_state", "tools")


def strip(text: Column) -> Column:
    """Without whitespace at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_calls(text: Column) -> Column:
    """array<struct<name, arguments: map>> of the calls in order; a repeated key keeps its last value."""

    def arguments(body: Column) -> Column:
        keys = F.regexp_extract_all(body, F.lit(PARAMETER), F.lit(1))
        values = F.regexp_extract_all(body, F.lit(PARAMETER), F.lit(2))
        pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), F.regexp_replace(v, r"^\n+|\n+$", "").alias("value")))
        # only the last entry of a key stays: maps refuse repeated keys
        last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
        return F.map_from_entries(last)

    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BLOCK), F.lit(1))
    functions = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(FUNCTION), F.lit(0))))
    return F.transform(
        functions,
        lambda f: F.struct(F.regexp_extract(f, FUNCTION, 1).alias("name"), arguments(F.regexp_extract(f, FUNCTION, 2)).alias("arguments")),
    )


def serialize_call(name: Column, arguments: Column) -> Column:
    """The text of a call, parameters in the order of the map's entries."""
    inner = F.transform(
        F.map_entries(arguments), lambda e: F.concat(F.lit("<parameter="), e["key"], F.lit(">\n"), e["value"], F.lit("\n</parameter>\n"))
    )
    return F.concat(F.lit("<tool_call>\n<function="), name, F.lit(">\n"), F.array_join(inner, ""), F.lit("</function>\n</tool_call>"))


def coerce(value: Column, declared: Column) -> Column:
    """A variant of the parameter text: verbatim for strings, else JSON, boolean, number, or the text.

    Numbers are what Python's int and float read: signs, leading zeros and points, single
    underscores between digits, inf and nan. A number that is not finite is a double.
    """
    bare = strip(value)
    low = F.lower(bare)
    as_text = value.cast("variant")
    digits = r"[0-9](_?[0-9])*"
    plain = F.replace(low, F.lit("_"), F.lit(""))
    whole = F.when(low.rlike(rf"^[+-]?{digits}$"), plain.try_cast("decimal(38,0)").cast("variant"))
    exponent = rf"(e[+-]?{digits})?"
    real = F.when(low.rlike(rf"^[+-]?({digits}\.?({digits})?|\.{digits}){exponent}$"), plain.try_cast("double"))
    special = F.when(low.rlike("^[+]?inf(inity)?$"), F.lit(float("inf"))).when(low.rlike("^-inf(inity)?$"), F.lit(float("-inf"))).when(low.rlike("^[+-]?nan$"), F.lit(float("nan")))
    guess = (
        F.when(bare.rlike(r"^[{\[]"), F.coalesce(F.try_parse_json(bare), as_text))
        .when(low.isin("true", "false"), (low == "true").cast("variant"))
        .otherwise(F.coalesce(whole, real.cast("variant"), special.cast("variant"), as_text))
    )
    return F.when(declared == "string", as_text).otherwise(guess)


def split_reasoning(text: Column) -> Column:
    """struct<reasoning, content>: the first think block and the text around it; unclosed: all reasoning."""
    opened = F.instr(text, "<think>") > 0
    closed = F.regexp_like(text, F.lit(r"(?s)<think>.*?</think>"))
    body = F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)
    rest = F.regexp_replace(text, r"(?s)^(.*?)<think>.*?</think>", "$1")
    return (
        F.when(closed, F.struct(strip(body).alias("reasoning"), strip(rest).alias("content")))
        .when(opened, F.struct(strip(F.regexp_extract(text, r"(?s)<think>(.*)$", 1)).alias("reasoning"), F.lit("").alias("content")))
        .otherwise(F.struct(F.lit("").alias("reasoning"), strip(text).alias("content")))
    )


def split_continuation(text: Column, thinking: bool = True) -> Column:
    """As ``split_reasoning`` for text whose think block was opened by the prompt."""
    at = F.instr(text, "</think>")
    split = F.struct(
        strip(F.substring_index(text, "</think>", 1)).alias("reasoning"), strip(F.substring(text, at + 8, F.length(text))).alias("content")
    )
    bare = strip(text)
    plain = F.struct((bare if thinking else F.lit("")).alias("reasoning"), (F.lit("") if thinking else bare).alias("content"))
    return F.when(F.instr(text, "<think>") > 0, split_reasoning(text)).when(at > 0, split).otherwise(plain)


def outside_calls(text: Column) -> Column:
    return strip(F.regexp_replace(text, BLOCK, ""))


def malformed_reason(text: Column) -> Column:
    """Why the marks of a call are broken; null if they are not."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return (
        F.when(text.rlike(r"<function=\s*>"), "empty function name")
        .when(count("<tool_call>") > count("</tool_call>"), "unclosed <tool_call> tag")
        .when(count("<function=") > count("</function>"), "unclosed <function=...> tag")
        .when(text.contains("<tool_call>") & ~text.contains("<function="), "<tool_call> block contains no <function=NAME>")
    )


def argument_reason(arguments: Column, signature: Column) -> Column:
    """Why parameter texts do not fit a signature; null if they do.

    ``signature``: array<struct<name, type, required>>. The first that holds: an unknown
    name, a value that its type cannot take, a required one that is missing.
    """
    declared = F.map_from_entries(F.transform(signature, lambda s: F.struct(s["name"], s["type"])))
    names = F.map_keys(arguments)
    unknown = F.array_sort(F.array_except(names, F.map_keys(declared)))
    missing = F.array_sort(F.array_except(F.transform(F.filter(signature, lambda s: s["required"]), lambda s: s["name"]), names))
    faults = F.transform(
        F.map_entries(arguments),
        lambda e: F.concat(F.lit("parameter "), e["key"], F.lit(": "), bound(coerce(e["value"], F.lit("any")), lambda v: python_calls.coerced(v, F.try_element_at(declared, e["key"])))["reason"]),
    )
    return (
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown parameter(s) "), F.array_join(unknown, ", ")))
        .otherwise(F.coalesce(
            F.get(F.filter(faults, lambda x: x.isNotNull()), 0),
            F.when(F.size(missing) > 0, F.concat(F.lit("missing required parameter(s) "), F.array_join(missing, ", "))),
        ))
    )


def parse_turn(text: Column, tools: Column | None = None, signatures: Column | None = None) -> Column:
    """struct<outcome, name, arguments, content, reasoning, reason> of an assistant turn.

    The outcome is malformed_syntax, no_call, unknown_tool, bad_arguments or ok, the first
    that holds; the first call counts. ``tools`` lists the known names; ``signatures`` maps
    a name to its parameters (``argument_reason``), and a name without one is unknown.
    """

    def of(x: Column) -> Column:
        first, malformed, thought = F.get(x["calls"], 0), x["malformed"], x["thought"]
        called = malformed.isNull() & (F.size(x["calls"]) > 0)
        unknown = F.lit(False) if tools is None else ~F.array_contains(tools, first["name"])
        why = F.lit(None).cast("string")
        if signatures is not None:
            signature = F.try_element_at(signatures, first["name"])
            unknown = unknown | signature.isNull()
            why = argument_reason(first["arguments"], signature)
        found = F.struct(
            F.coalesce(malformed, F.when(called & unknown, F.concat(first["name"], F.lit(" is not one of this environment's tools"))), F.when(called, why)).alias("reason"),
            F.when(malformed.isNotNull(), "malformed_syntax").when(~called, "no_call").when(unknown, "unknown_tool").alias("early"),
        )
        return bound(
            found,
            lambda f: F.struct(
                F.coalesce(f["early"], F.when(f["reason"].isNotNull(), "bad_arguments").otherwise("ok")).alias("outcome"),
                F.when(called, first["name"]).alias("name"), F.when(called, first["arguments"]).alias("arguments"),
                F.when(called, outside_calls(thought["content"])).otherwise(thought["content"]).alias("content"), thought["reasoning"].alias("reasoning"), f["reason"].alias("reason"),
            ),
        )

    parts = F.struct(parse_calls(text).alias("calls"), malformed_reason(text).alias("malformed"), split_reasoning(text).alias("thought"))
    return F.when(text.isNotNull(), bound(parts, of))


def classify_turn(text: Column, tools: Column | None = None, signatures: Column | None = None) -> Column:
    """The outcome of ``parse_turn``."""
    return parse_turn(text, tools, signatures)["outcome"]


def _kind(value: Column) -> Column:
    """What a variant is: OBJECT, ARRAY, STRING, BIGINT, VOID and so on."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _json_call(value: Column, keys: tuple[str, ...]) -> Column:
    """The call that a variant holds; its arguments are under the first of ``keys`` that it has, or none; null for anything else."""
    given = F.coalesce(*[F.try_variant_get(value, f"$.{k}", "variant") for k in keys], F.try_parse_json(F.lit("{}")))
    sound = (_kind(value) == "OBJECT") & (_kind(F.try_variant_get(value, "$.name", "variant")) == "STRING") & (_kind(given) == "OBJECT")
    call = F.struct(F.try_variant_get(value, "$.name", "string").alias("name"), F.try_variant_get(given, "$", "map<string,string>").alias("arguments"))
    return F.when(sound, call)


def json_calls(text: Column) -> Column:
    """The calls that the last line holds as a JSON object or list; any bad element empties it."""
    line = strip(F.element_at(F.split(strip(text), "\n"), -1))
    value = F.when(line.rlike(r"^[\[{]"), F.try_parse_json(line))
    items = F.when(_kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))
    found = F.transform(items, lambda v: _json_call(v, ("arguments", "args")))
    return F.when(value.isNotNull() & F.forall(found, lambda c: c.isNotNull()), found).otherwise(F.array().cast(CALLS))


def block_calls(text: Column) -> Column:
    """The calls of blocks that hold one JSON object; other blocks are passed over."""
    bodies = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BLOCK), F.lit(1))
    return F.filter(F.transform(bodies, lambda b: _json_call(F.try_parse_json(strip(b)), ("arguments",))), lambda c: c.isNotNull())


def any_calls(text: Column) -> Column:
    """XML calls, else the calls of JSON blocks, else those of a JSON last line."""
    either = lambda first, other: bound(first, lambda x: F.when(F.size(x) > 0, x).otherwise(other))
    return either(parse_calls(text), either(block_calls(text), json_calls(text)))


def _closing(text: Column) -> Column:
    rest = F.lower(F.substring_index(text, "</think>", -1))
    return F.regexp_replace(rest, r"^[<>\s.!?]+|[<>\s.!?]+$", "")


def is_done(text: Column) -> Column:
    """Whether what follows the last think block is one of the closing marks."""
    return _closing(text).isin(*DONE_WORDS)


def is_task_error(text: Column) -> Column:
    return _closing(text) == ERROR_WORD


def is_tool_method(name: Column) -> Column:
    return ~name.startswith("_") & ~name.isin(*RESERVED)


def is_error(result: Column) -> Column:
    return result.startswith("Error during execution:") | F.coalesce(F.array_contains(F.json_object_keys(result), "error"), F.lit(False))


def _without_none(annotation: Column) -> Column:
    """What a union with None holds besides, if that is one type; other annotations as they are."""
    union = F.regexp_replace(F.regexp_replace(F.regexp_extract(annotation, r"^Union\[(.*)\]$", 1), r",\s*None\s*$", ""), r"^\s*None\s*,\s*", "")
    flat = union
    for _ in range(4):
        flat = F.regexp_replace(flat, r"\[[^\[\]]*\]", "")
    inner = F.when((union != "") & ~flat.contains(","), union).otherwise(F.regexp_replace(annotation, r"^Optional\[(.*)\]$", "$1"))
    return strip(F.regexp_replace(F.regexp_replace(inner, r"\s*\|\s*None$", ""), r"^None\s*\|\s*", ""))


def json_type(annotation: Column) -> Column:
    """The JSON schema type of an annotation, optional ones unwrapped; string if unknown."""
    bare = bound(bound(strip(F.regexp_replace(annotation, r"\btyping\.", "")), _without_none), _without_none)

    def of(name: Column) -> Column:
        out = F.lit("string")
        for names, kind in ((("int",), "integer"), (("float",), "number"), (("bool",), "boolean"), (("list", "List"), "array"), (("dict", "Dict"), "object")):
            out = F.when(name.isin(*names), kind).otherwise(out)
        return out

    return F.when(annotation.isNotNull(), bound(F.regexp_extract(bare, r"^([A-Za-z]+)(\[.*\])?$", 1), of))
