"""Trajectories: parse and account for every row, trim, render, mask, convert or skip."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellium.functions.text import is_user_turn, malformed_key, python_json
from trellium.functions.toolcalls import strip

CALL = "struct<function:struct<name:string,arguments:string>,name:string,arguments:string>"
MESSAGE = f"struct<role:string,content:string,reasoning_content:string,name:string,tool_calls:array<{CALL}>>"


def parse_release(rows: DataFrame) -> DataFrame:
    """Release rows (task_info, traj_type, messages, tools, steps, user_messages if there) with decoded fields and the first fault.

    ``malformed_reason`` is null for good rows; no row is dropped. Tools that are no objects
    are left out, and user messages that are no strings become their JSON.
    """
    listed_messages = F.try_variant_get(F.try_parse_json("messages"), "$", "array<variant>")
    messages = F.transform(listed_messages, message_of)
    said = F.col("user_messages") if "user_messages" in rows.columns else F.lit(None).cast("string")

    def listed(column: Column) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_parse_json(column)).startswith("ARRAY"), F.lit(False))

    def fault(column: Column, name: str) -> Column:
        return F.when(F.try_parse_json(column).isNull() & column.isNotNull(), f"{name}: not JSON").when(
            column.isNotNull() & ~listed(column) & ~strip(column).isin("null", "{}", '""', "0", "false"), f"{name}: not a list"
        )

    reason = (
        F.when(F.col("task_info").isNull(), "task_info: not an object")
        .when(F.coalesce(F.col("task_info.task_id"), F.lit("")) == "", "task_info.task_id: empty")
        .when(F.try_parse_json("messages").isNull(), "messages: not JSON")
        .when(messages.isNull() | ~listed(F.col("messages")), "messages: not a list")
        .when(F.size(messages) == 0, "messages: empty")
        .when(F.exists(listed_messages, lambda m: ~F.coalesce(F.schema_of_variant(m).startswith("OBJECT"), F.lit(False))), "messages: not an object")
        .when(F.exists(messages, lambda m: F.coalesce(m["role"], F.lit("")) == ""), "messages.role: empty")
    )
    faults = F.coalesce(reason, fault(F.col("tools"), "tools"), fault(said, "user_messages"))
    variants = lambda c: F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    objects = F.filter(variants(F.col("tools")), lambda t: F.schema_of_variant(t).startswith("OBJECT"))
    spoken = F.transform(variants(said), lambda u: F.when(F.schema_of_variant(u) == "STRING", F.try_variant_get(u, "$", "string")).otherwise(python_json(F.to_json(u))))
    return rows.withColumns({
        "malformed_reason": faults,
        "uid": F.concat_ws(":", "task_info.task_id", "traj_type"),
        "decoded": F.transform(messages, normalize_message),
        "tool_list": F.transform(F.coalesce(objects, F.array().cast("array<variant>")), lambda t: F.to_json(t)),
        "said": F.coalesce(spoken, F.array().cast("array<string>")),
        "n_steps": F.coalesce(F.col("steps"), F.lit(0)).cast("int"),
    })


def message_of(m: Column) -> Column:
    """A message that a variant holds, as ``MESSAGE``: a role that is no text is none, content that is no text becomes its JSON."""

    def field(name: str, other=None) -> Column:
        found = F.try_variant_get(m, f"$.{name}", "variant")
        kind = F.schema_of_variant(found)
        text = F.when(kind == "STRING", F.try_variant_get(found, "$", "string"))
        return text if other is None else text.when(kind != "VOID", other(F.to_json(found)))

    calls = F.try_variant_get(m, "$.tool_calls", f"array<{CALL}>")
    return F.struct(
        field("role").alias("role"), field("content", python_json).alias("content"), field("reasoning_content", lambda x: x).alias("reasoning_content"), field("name").alias("name"), calls.alias("tool_calls")
    )


def call_arguments(text: Column) -> Column:
    """The arguments of a call as a JSON object: text that is no JSON under ``__raw__``, a value that is no object under ``__value__``."""
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    return (
        F.when(text.isNull(), "{}")
        .when(parsed.isNull(), F.to_json(F.struct(text.alias("__raw__"))))
        .when(kind.startswith("OBJECT"), F.to_json(parsed))
        .otherwise(F.concat(F.lit('{"__value__":'), F.coalesce(F.to_json(parsed), F.lit("null")), F.lit("}")))
    )


def normalize_message(m: Column) -> Column:
    """Empty reasoning as null, and tool calls as named (name, arguments)."""
    calls = F.filter(
        F.transform(
            m["tool_calls"],
            lambda c: F.struct(
                F.nullif(F.coalesce(c["function"]["name"], c["name"]), F.lit("")).alias("name"),
                call_arguments(F.coalesce(c["function"]["arguments"], c["arguments"])).alias("arguments"),
            ),
        ),
        lambda c: c["name"].isNotNull(),
    )
    return F.struct(m["role"].alias("role"), m["content"].alias("content"), F.nullif(m["reasoning_content"], F.lit("")).alias("reasoning_content"), m["name"].alias("name"), calls.alias("tool_calls"))


def message_json(m: Column) -> Column:
    """A normalised message as the JSON that a template takes: null fields left out, calls wrapped as functions."""
    wrapped = F.transform(m["tool_calls"], lambda c: F.struct(F.lit("function").alias("type"), F.struct(c["name"].alias("name"), F.parse_json(c["arguments"]).alias("arguments")).alias("function")))
    some = F.when(F.size(m["tool_calls"]) > 0, wrapped)
    return F.to_json(F.struct(m["role"].alias("role"), m["content"].alias("content"), m["reasoning_content"].alias("reasoning_content"), m["name"].alias("name"), some.alias("tool_calls")))


def template_messages(messages: Column, reasoning: bool = True) -> Column:
    """Messages as a chat template takes them: tool results wrapped as user turns."""

    def one(m: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        shown = content if reasoning else strip(F.substring_index(content, "</think>", -1))
        wrapped = F.concat(F.lit("<tool_response>\n"), content, F.lit("\n</tool_response>"))
        return F.struct(
            F.when(m["role"] == "tool", "user").otherwise(m["role"]).alias("role"),
            F.when(m["role"] == "tool", wrapped).when(m["role"] == "assistant", shown).otherwise(content).alias("content"),
        )

    return F.transform(messages, one)


def render(messages: Column) -> Column:
    """The turns between start and end marks, one after the other."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


#: How the tools of a conversation are announced to the model.
TOOLS_HEAD = "# Tools\n\nYou have access to the following functions:\n\n<tools>"
TOOLS_TAIL = "\n</tools>"


def with_history(messages: Column, keep_reasoning: bool = False) -> Column:
    """Assistant turns with their reasoning in a think block, where it is kept: always, or only after the last turn of the user.

    ``messages`` have role, content and reasoning_content; a user turn that wraps a tool's
    result does not count as one of the user.
    """
    def spoken(m: Column) -> Column:
        content = strip(F.coalesce(m["content"], F.lit("")))
        return (m["role"] == "user") & ~(content.startswith("<tool_response>") & content.endswith("</tool_response>"))

    asked = F.array_max(F.transform(messages, lambda m, i: F.when(spoken(m), i).otherwise(-1)))

    def one(m: Column, i: Column) -> Column:
        content = strip(F.coalesce(m["content"], F.lit("")))
        thought = F.coalesce(m["reasoning_content"], F.when(F.instr(content, "</think>") > 0, F.substring_index(F.substring_index(content, "</think>", 1), "<think>", -1)), F.lit(""))
        answer = F.when(m["reasoning_content"].isNull(), F.regexp_replace(F.substring_index(content, "</think>", -1), r"^\n+", "")).otherwise(content)
        shown = F.lit(True) if keep_reasoning else i > asked
        block = F.concat(F.lit("<think>\n"), strip(thought), F.lit("\n</think>\n\n"), answer)
        return F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", F.when(shown, block).otherwise(answer)).otherwise(content).alias("content"))

    return F.transform(messages, one)


def tools_prompt(tools: Column, system: Column) -> Column:
    """The system message that announces tools (JSON texts) before what the system says; the latter alone without tools."""
    listed = F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), t)), "")
    rest = F.when(F.coalesce(strip(system), F.lit("")) != "", F.concat(F.lit("\n\n"), strip(system))).otherwise("")
    return F.when(F.size(tools) > 0, F.concat(F.lit(TOOLS_HEAD), listed, F.lit(TOOLS_TAIL), rest)).otherwise(strip(system))


def trim_after_last_assistant(turns: DataFrame, key: str = "conv_id", order: str = "turn", strict: bool = False) -> DataFrame:
    """Rows up to the last assistant turn of each trajectory, and how many were cut.

    A trajectory without a turn of the user, or without an assistant turn after one, has
    nothing to train on: it is left out, or an error if ``strict``.
    """
    by = Window.partitionBy(key)
    user = is_user_turn(F.col("role"), F.col("text"))
    marked = turns.withColumn("_last", F.max(F.when(F.col("role") == "assistant", F.col(order))).over(by)).withColumn("_asked", F.min(F.when(user, F.col(order))).over(by))
    fault = F.when(F.col("_asked").isNull(), "no turn of the user").when(F.coalesce(F.col("_last") < F.col("_asked"), F.lit(True)), "no assistant turn after one of the user")
    if strict:
        message = F.concat(F.col(key).cast("string"), F.lit(": "), fault)
        marked = marked.where(F.when(fault.isNull(), True).otherwise(F.raise_error(message).cast("boolean")))
    else:
        marked = marked.where(fault.isNull())
    cut = F.count_if(F.col(order) > F.col("_last")).over(by)
    return marked.withColumn("removed", cut).where(F.col(order) <= F.col("_last")).drop("_last", "_asked")


def mask_counts(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Tokens and supervised (assistant) tokens per trajectory; whitespace tokens stand for a tokenizer's."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return turns.groupBy(key).agg(
        F.sum(n).cast("long").alias("tokens"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).cast("long").alias("supervised"),
        F.count_if(is_user_turn(F.col("role"), F.col("text"))).alias("user_turns"),
    )


def convert_or_skip(counts: DataFrame, cap: int) -> DataFrame:
    """status and reason: skipped whole if unsupervised or beyond the cap, never truncated."""
    reason = F.when(F.col("user_turns") == 0, "unrenderable: no user turn").when(F.col("supervised") == 0, "unrenderable: nothing supervised").when(F.col("tokens") > cap, "too_long")
    return counts.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "converted").otherwise("skipped"))


def accounting(rows: DataFrame) -> DataFrame:
    """Counts by status and reason key, with supervised tokens of what was converted."""
    key = F.coalesce(malformed_key(F.col("reason")), F.lit(""))
    return rows.groupBy("status", key.alias("reason")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("status") == "converted", F.col("supervised")).otherwise(0)).alias("supervised"))


def training_record(rows: DataFrame, version: int, semantics: str, fingerprint: str | None = None) -> DataFrame:
    """The versioned record: ids, labels, what can be checked about them, and the template they were rendered with."""
    from trellium.functions.arrays import labels_of, supervised

    labelled = rows.withColumn("labels", labels_of(F.col("input_ids"), F.col("mask")))
    more = {"template_fingerprint": F.lit(fingerprint)} if fingerprint is not None else {}
    return labelled.withColumns({
        "schema_version": F.lit(version), "semantics": F.lit(semantics), "seq_length": F.size("input_ids"), "supervised_tokens": supervised(F.col("labels")), **more,
    }).drop("mask")


#: The columns of a persisted training record, in its order.
RECORD = (
    "schema_version", "semantics", "trajectory_uid", "task_id", "env_id", "mode", "input_ids", "labels", "seq_length", "supervised_tokens", "template_fingerprint", "trailing_messages_removed",
)


def sft_records(turns: DataFrame, about: DataFrame, tokenizer: Callable[[Column], Column], version: int, semantics: str, mode: str, fingerprint: str, key: str = "trajectory_uid", order: str = "turn") -> DataFrame:
    """RECORD, a row per trajectory that can be trained on, from its turns (key, order, role, text).

    What follows the last assistant turn is removed and counted. Each turn's tokens are
    supervised if the assistant said it. ``about`` has task_id and env_id by key.
    """
    trimmed = trim_after_last_assistant(turns, key, order)
    each = tokenized(trimmed, tokenizer, "text", "_ids").select(key, "removed", F.struct(order, F.col("_ids").alias("ids"), (F.col("role") == "assistant").alias("own")).alias("_t"))
    whole = each.groupBy(key).agg(F.max("removed").cast("int").alias("trailing_messages_removed"), F.array_sort(F.collect_list("_t")).alias("_turns"))
    laid = whole.select(
        key, "trailing_messages_removed", F.flatten(F.transform("_turns", lambda t: t["ids"])).alias("input_ids"),
        F.flatten(F.transform("_turns", lambda t: F.transform(t["ids"], lambda _: t["own"].cast("int")))).alias("mask"),
    )
    made = training_record(laid, version, semantics, fingerprint).join(about, key).withColumn("mode", F.lit(mode))
    return made.where("supervised_tokens > 0").withColumnRenamed(key, "trajectory_uid").select(*RECORD)


def tokenized(rows: DataFrame, tokenizer: Callable[[Column], Column], text: str = "text", out: str = "input_ids") -> DataFrame:
    """``rows`` with the ids that a plugged-in tokenizer, a column function or an Arrow UDF, makes of the text."""
    return rows.withColumn(out, tokenizer(F.col(text)))


def hashed_words(buckets: int = 1 << 15) -> Callable[[Column], Column]:
    """A tokenizer without a vocabulary: whitespace words by hash."""
    return lambda text: F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(buckets)).cast("int"))
