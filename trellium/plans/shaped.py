"""Queries whose texts are made of the tables' own by one SQL expression, the same for both engines, and what computes on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.functions import arrays, python_calls, text, toolcalls
from trellium.operators import checks, conditions, trajectories
from trellium.plans.queries import query, read

SQL: dict[str, str] = {}


def _turns(spark: SparkSession, sf_dir: str, made: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(made).alias("t"))


def _events(spark: SparkSession, sf_dir: str, made: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "event_type", "props", F.expr(made).alias("t"))


def _of_turns(made: str, columns: str, where: str = "true") -> str:
    return f"WITH s AS (SELECT conv_id, turn, {made} AS t FROM conversations) SELECT conv_id, turn, {columns} FROM s WHERE {where}"


def _of_events(made: str, columns: str, where: str = "true") -> str:
    return f"WITH s AS (SELECT event_id, event_type, props, {made} AS t FROM events) SELECT event_id, {columns} FROM s WHERE {where}"


def _bare(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


THOUGHT = "CASE WHEN turn % 4 = 0 THEN '<think> ' || role || ' </think> ' || text WHEN turn % 4 = 1 THEN text || '<think>' || role WHEN turn % 4 = 2 THEN role || ' <think>' || text || '</think> ' || role ELSE ' ' || text || chr(10) END"
_OPEN, _CLOSE = "strpos(t, '<think>')", "strpos(substr(t, strpos(t, '<think>')), '</think>')"
SQL["split_reasonings"] = _of_turns(
    THOUGHT,
    f"CASE WHEN {_OPEN} = 0 THEN '' WHEN {_CLOSE} > 0 THEN {_bare(f'substr(t, {_OPEN} + 7, {_CLOSE} - 8)')} ELSE {_bare(f'substr(t, {_OPEN} + 7)')} END AS reasoning, "
    f"CASE WHEN {_OPEN} = 0 THEN {_bare('t')} WHEN {_CLOSE} > 0 THEN {_bare(f'substr(t, 1, {_OPEN} - 1) || substr(t, {_OPEN} + {_CLOSE} + 7)')} ELSE '' END AS content",
)


@query
def split_reasonings(spark, sf_dir):
    s = toolcalls.split_reasoning(F.col("t"))
    return _turns(spark, sf_dir, THOUGHT).select("conv_id", "turn", s["reasoning"].alias("reasoning"), s["content"].alias("content"))


CONTINUED = "CASE WHEN turn % 3 = 0 THEN role || ' </think> ' || text WHEN turn % 3 = 1 THEN chr(10) || text || ' ' ELSE '<think>' || role || '</think>' || text END"
_END = "strpos(t, '</think>')"
SQL["split_continuations"] = _of_turns(
    CONTINUED,
    f"CASE WHEN {_END} = 0 THEN '' WHEN {_OPEN} > 0 THEN {_bare(f'substr(t, 8, {_END} - 8)')} ELSE {_bare(f'substr(t, 1, {_END} - 1)')} END AS reasoning, "
    f"CASE WHEN {_END} = 0 THEN {_bare('t')} ELSE {_bare(f'substr(t, {_END} + 8)')} END AS content",
)


@query
def split_continuations(spark, sf_dir):
    s = toolcalls.split_continuation(F.col("t"), False)
    return _turns(spark, sf_dir, CONTINUED).select("conv_id", "turn", s["reasoning"].alias("reasoning"), s["content"].alias("content"))


CALLING = (
    "CASE (conv_id + turn) % 8 WHEN 0 THEN text WHEN 1 THEN text || '<tool_call><function=' || role || '><parameter=n> ' || turn || '</parameter></function></tool_call>' "
    "WHEN 2 THEN '<think>' || text || '</think><tool_call><function=' || role || '><parameter=n>' || role || '</parameter></function></tool_call>' "
    "WHEN 3 THEN '<tool_call><function=' || role || '>' || text WHEN 4 THEN '<tool_call>' || text || '</tool_call>' "
    "WHEN 5 THEN '<tool_call><function=' || role || '><parameter=' || role || '>1</parameter></function></tool_call>' "
    "WHEN 6 THEN '<tool_call><function=' || role || '></function></tool_call>' ELSE '<tool_call><function= ></function></tool_call>' || text END"
)
_COUNT = "len(regexp_extract_all(t, '{}'))"
_NAME, _KEY = r"regexp_extract(t, '(?s)<tool_call>.*?<function=([^\s>]+)>', 1)", r"regexp_extract(t, '<parameter=([^\s>]+)>', 1)"
SQL["classify_turns"] = _of_turns(
    CALLING,
    rf"""CASE WHEN regexp_matches(t, '<function=\s*>') OR {_COUNT.format('<tool_call>')} > {_COUNT.format('</tool_call>')} OR {_COUNT.format('<function=')} > {_COUNT.format('</function>')}
        OR ({_COUNT.format('<tool_call>')} > 0 AND {_COUNT.format('<function=')} = 0) THEN 'malformed_syntax' WHEN {_NAME} = '' THEN 'no_call' WHEN {_NAME} <> 'assistant' THEN 'unknown_tool'
        WHEN {_KEY} <> 'n' OR NOT regexp_full_match(trim(regexp_extract(t, '<parameter=n>([^<]*)</parameter>', 1)), '[+-]?[0-9]+') THEN 'bad_arguments' ELSE 'ok' END AS outcome""",
)


@query
def classify_turns(spark, sf_dir):
    signature = F.array(F.struct(F.lit("n").alias("name"), F.lit("integer").alias("type"), F.lit(True).alias("required")))
    outcome = toolcalls.classify_turn(F.col("t"), F.array(F.lit("assistant")), F.create_map(F.lit("assistant"), signature))
    return _turns(spark, sf_dir, CALLING).select("conv_id", "turn", outcome.alias("outcome"))


CALLED = (
    "CASE WHEN turn % 4 = 0 THEN text || '<tool_call><function=' || role || '><parameter=a>' || text || '</parameter></function></tool_call>' "
    "WHEN turn % 4 = 1 THEN '<tool_call>' || chr(10) || '{\"name\":' || chr(10) || '\"' || role || '\", \"arguments\": {\"a\": 1}}</tool_call>' || text "
    "WHEN turn % 4 = 2 THEN text || chr(10) || '[{\"name\": \"' || role || '\", \"args\": {}}, {\"name\": \"x\"}]' ELSE text END"
)
_LINE = "regexp_extract(t, '([^\\n]*)$', 1)"
SQL["call_cascade"] = _of_turns(
    CALLED,
    "CASE WHEN t LIKE '%<function=%' THEN array_to_string(regexp_extract_all(t, '<function=([^>]*)>', 1), ',') "
    "WHEN t LIKE '%<tool_call>%' THEN json_extract_string(regexp_extract(t, '<tool_call>([^<]*)</tool_call>', 1), '$.name') "
    f"WHEN {_LINE} LIKE '[%' AND json_valid({_LINE}) THEN array_to_string(json_extract_string({_LINE}, '$[*].name'), ',') ELSE '' END AS names",
)


@query
def call_cascade(spark, sf_dir):
    names = F.transform(toolcalls.any_calls(F.col("t")), lambda c: c["name"])
    return _turns(spark, sf_dir, CALLED).select("conv_id", "turn", F.array_join(names, ",").alias("names"))


AROUND = "CASE WHEN turn % 2 = 0 THEN ' ' || role || ' <tool_call>' || text || '</tool_call> ' || text ELSE ' ' || text || ' ' END"
SQL["content_outside_calls"] = _of_turns(
    AROUND,
    "CASE WHEN strpos(t, '<tool_call>') > 0 THEN " + _bare("substr(t, 1, strpos(t, '<tool_call>') - 1) || substr(t, strpos(t, '</tool_call>') + 12)") + f" ELSE {_bare('t')} END AS content",
)


@query
def content_outside_calls(spark, sf_dir):
    return _turns(spark, sf_dir, AROUND).select("conv_id", "turn", toolcalls.outside_calls(F.col("t")).alias("content"))


CLOSED = "CASE WHEN turn % 4 = 0 THEN '<think>' || text || '</think> Task_Finished.' WHEN turn % 4 = 1 THEN text || '</think>task_ERROR!' WHEN turn % 4 = 2 THEN text || ' finish' ELSE '</think>' || upper('finish') || role END"
_SAID = "regexp_replace(regexp_replace(lower(list_extract(string_split(t, '</think>'), -1)), '^[<>\\s.!?]+', ''), '[<>\\s.!?]+$', '')"
SQL["closing_marks"] = _of_turns(CLOSED, f"{_SAID} IN ('task_finished', 'task finished', 'task completed', 'finish') AS done, {_SAID} = 'task_error' AS failed")


@query
def closing_marks(spark, sf_dir):
    return _turns(spark, sf_dir, CLOSED).select("conv_id", "turn", toolcalls.is_done(F.col("t")).alias("done"), toolcalls.is_task_error(F.col("t")).alias("failed"))


RESULT = "CASE WHEN turn % 4 = 0 THEN 'Error during execution: ' || text WHEN turn % 4 = 1 THEN '{\"error\": \"' || role || '\"}' WHEN turn % 4 = 2 THEN '{\"ok\": \"error\"}' ELSE text END"
SQL["error_results"] = _of_turns(RESULT, "starts_with(t, 'Error during execution:') OR (json_valid(t) AND list_contains(json_keys(CASE WHEN json_valid(t) THEN t ELSE '{}' END), 'error')) AS error")


@query
def error_results(spark, sf_dir):
    return _turns(spark, sf_dir, RESULT).select("conv_id", "turn", toolcalls.is_error(F.col("t")).alias("error"))


METHOD = "CASE WHEN event_id % 4 = 0 THEN '_' || event_type WHEN event_id % 4 = 1 THEN 'get_state' WHEN event_id % 4 = 2 THEN event_type || '_' || event_id ELSE event_type END"
SQL["tool_methods"] = _of_events(
    METHOD, "t AS method",
    "NOT starts_with(t, '_') AND t NOT IN ('reset', 'step', 'close', 'render', 'seed', 'state', 'get_state', 'get_state_info', 'final_state', 'initial_state', 'tools')",
)


@query
def tool_methods(spark, sf_dir):
    return _events(spark, sf_dir, METHOD).where(toolcalls.is_tool_method(F.col("t"))).select("event_id", F.col("t").alias("method"))


ANNOTATED = (
    "CASE WHEN event_id % 3 = 0 THEN 'Optional[' WHEN event_id % 3 = 1 THEN '' ELSE '' END || CASE WHEN event_id % 7 = 0 THEN 'int' WHEN event_id % 7 = 1 THEN 'float' WHEN event_id % 7 = 2 THEN 'bool' "
    "WHEN event_id % 7 = 3 THEN 'list[int]' WHEN event_id % 7 = 4 THEN 'Dict[str, ' || event_type || ']' WHEN event_id % 7 = 5 THEN 'str' ELSE event_type END || CASE WHEN event_id % 3 = 0 THEN ']' WHEN event_id % 3 = 2 THEN ' | None' ELSE '' END"
)
_KIND = "lower(regexp_extract(CASE WHEN t LIKE 'Optional[%' THEN substr(t, 10) ELSE t END, '^[A-Za-z]+'))"
SQL["annotation_types"] = _of_events(
    ANNOTATED, f"CASE {_KIND} WHEN 'int' THEN 'integer' WHEN 'float' THEN 'number' WHEN 'bool' THEN 'boolean' WHEN 'list' THEN 'array' WHEN 'dict' THEN 'object' ELSE 'string' END AS kind"
)


@query
def annotation_types(spark, sf_dir):
    return _events(spark, sf_dir, ANNOTATED).select("event_id", toolcalls.json_type(F.col("t")).alias("kind"))


VALUED = (
    "CASE event_id % 10 WHEN 0 THEN cast(event_id AS varchar(20)) WHEN 1 THEN '+' || event_id WHEN 2 THEN event_id || '.5' WHEN 3 THEN '.' || event_id WHEN 4 THEN event_id || '.' WHEN 5 THEN '00' || event_id "
    "WHEN 6 THEN '1_0' || event_id WHEN 7 THEN props WHEN 8 THEN upper('true') ELSE event_type || ' ' || event_id END"
)
SQL["parameter_values"] = _of_events(
    VALUED,
    r"""CASE WHEN json_valid(t) AND t LIKE '{%' THEN replace(t, ' ', '') WHEN lower(t) IN ('true', 'false') THEN lower(t)
        WHEN regexp_full_match(t, '[+-]?[0-9](_?[0-9])*') THEN replace(t, '_', '')::BIGINT::VARCHAR WHEN regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') THEN t::DOUBLE::VARCHAR ELSE '"' || t || '"' END AS value,
        to_json(t)::VARCHAR AS as_string""",
)


@query
def parameter_values(spark, sf_dir):
    made = F.to_json(toolcalls.coerce(F.col("t"), F.lit("any")))
    return _events(spark, sf_dir, VALUED).select("event_id", made.alias("value"), F.to_json(toolcalls.coerce(F.col("t"), F.lit("string"))).alias("as_string"))


GIVEN = "CASE event_id % 5 WHEN 0 THEN event_id || '.0' WHEN 1 THEN event_id || '.25' WHEN 2 THEN '\"' || event_id || '\"' WHEN 3 THEN event_type ELSE '-' || event_id END"
SQL["argument_coercion"] = _of_events(
    GIVEN,
    r"""CASE WHEN regexp_full_match(trim(t, '"'), '-?[0-9]+(\.0+)?') THEN regexp_replace(trim(t, '"'), '\.0+$', '') END AS value,
        CASE WHEN NOT regexp_full_match(trim(t, '"'), '-?[0-9]+(\.0+)?') THEN 'not integer' END AS reason""",
)


@query
def argument_coercion(spark, sf_dir):
    made = python_calls.coerce_argument(F.col("t"), F.lit("integer"))
    return _events(spark, sf_dir, GIVEN).select("event_id", made["value"].alias("value"), made["reason"].alias("reason"))


#: The final state of an event: its own fields, what it has read, and its totals; the initial one: its fields alone.
STATE = "'{\"k\": ' || coalesce(regexp_extract(props, '[0-9]+', 0), 'null') || ', \"kind\": \"' || event_type || '\", \"seen\": [{\"n\": ' || event_id % 7 || ', \"ok\": true}, {\"n\": ' || event_id % 3 || ', \"ok\": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}]}'"
CONDITIONS = {
    "large": "final_state['k'] > 50 and final_state['kind'] != 'error'", "all_seen": "all(x['n'] > 0 for x in final_state['seen'] if x['ok'])", "sum_seen": "sum(x['n'] for x in final_state['seen']) >= 4",
    "same_k": "final_state['k'] == initial_state['k']", "known": "final_state['kind'] in ['click', 'view'] or final_state['k'] % 2 == 0", "typo": "final_stat['k'] > 0", "number": "final_state['k'] + 1", "missing": "final_state['gone'] == 1",
}
_K = "regexp_extract(props, '[0-9]+', 0)::INT"
SQL["state_conditions"] = f"""
WITH s AS (SELECT event_id, event_type, {_K} AS k, event_id % 7 AS a, event_id % 3 AS b, event_id % 2 = 0 AS ok FROM events)
SELECT event_id, item, passed, error_type FROM s, LATERAL (VALUES ('large', k > 50 AND event_type <> 'error', NULL), ('all_seen', a > 0 AND (NOT ok OR b > 0), NULL), ('sum_seen', a + b >= 4, NULL),
  ('same_k', true, NULL), ('known', event_type IN ('click', 'view') OR k % 2 = 0, NULL), ('typo', false, 'NameError'), ('number', false, 'NonBoolResult'), ('missing', false, 'LookupError')) v(item, passed, error_type)"""


@query
def state_conditions(spark, sf_dir):
    # a file of events has few row groups, and what a row takes is computing: the rows are spread before their states are made
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "props").repartition(2 * spark.sparkContext.defaultParallelism)
    states = events.select("event_id", F.expr(STATE).alias("final_state"), F.col("props").alias("initial_state"))
    return conditions.run(states, CONDITIONS).select("event_id", "item", "passed", "error_type")


PYTHON = "CASE event_id % 4 WHEN 0 THEN event_type || '(' || event_id || ', k=''' || event_type || ''')' WHEN 1 THEN event_type || '.run()' WHEN 2 THEN event_type || '(*' || event_type || ')' ELSE event_type || ' ' || event_id END"
SQL["python_call_text"] = _of_events(
    PYTHON,
    r"""CASE WHEN regexp_matches(t, '^[a-z_.]+\([^*]*\)$') THEN regexp_extract(t, '^([a-z_.]+)\(', 1) END AS name,
        CASE WHEN regexp_matches(t, '^[a-z_.]+\([^*]*\)$') THEN regexp_extract(t, '\(([0-9]*)', 1) END AS args, nullif(regexp_extract(t, 'k=''([^'']*)''', 1), '') AS k""",
)


@query
def python_call_text(spark, sf_dir):
    made = _events(spark, sf_dir, PYTHON).select("event_id", python_calls.parse_python_calls(F.col("t")).alias("c"))
    return made.select("event_id", F.col("c.name").alias("name"), F.array_join("c.args", ",").alias("args"), F.get_json_object(F.concat(F.lit('{"v":'), F.col("c.kwargs")["k"], F.lit("}")), "$.v").alias("k"))


SQL["call_texts"] = "SELECT event_id, event_type || '(k=' || json_extract_string(props, '$.k') || ', who=''' || event_type || ''')' AS call FROM events"


@query
def call_texts(spark, sf_dir):
    given = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "who": "'), F.col("event_type"), F.lit('"}'))
    return read(spark, sf_dir, "events").select("event_id", python_calls.call_text(F.col("event_type"), given).alias("call"))


FIELDS = "CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{\"k\": \"' || event_type || '\"}' ELSE event_type END"
SQL["typed_fields"] = _of_events(
    FIELDS,
    """CASE WHEN json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t ELSE '{}' END, '$.k') IN ('UBIGINT', 'BIGINT') THEN json_extract_string(CASE WHEN json_valid(t) THEN t ELSE '{}' END, '$.k') END AS value,
        CASE WHEN json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t ELSE '{}' END, '$.k') IN ('UBIGINT', 'BIGINT') THEN NULL ELSE 'k: no integer' END AS fault""",
)


@query
def typed_fields(spark, sf_dir):
    f = text.json_field(F.col("t"), "k", "integer")
    return _events(spark, sf_dir, FIELDS).select("event_id", f["value"].alias("value"), f["fault"].alias("fault"))


REVISION = "CASE event_id % 4 WHEN 0 THEN substr(md5(event_type) || md5(props), 1, 40) WHEN 1 THEN upper(substr(md5(props) || md5(props), 3, 40)) WHEN 2 THEN substr(md5(props) || md5(props), 1, 39) ELSE substr(md5(props) || md5(props), 1, 40) || chr(10) END"
SQL["commit_ids"] = _of_events(REVISION, "t AS revision", "regexp_full_match(t, '[0-9a-fA-F]{40}')")


@query
def commit_ids(spark, sf_dir):
    return _events(spark, sf_dir, REVISION).where(text.is_commit(F.col("t"))).select("event_id", F.col("t").alias("revision"))


SAMPLED = "n_chars % 5 AS a, n_chars % 5 + 7 AS b, (n_chars + doc_id) % 9 AS taken, -n_chars / 1000.0 AS p, -doc_id / 1000.0 AS q"
SQL["sampled_logprobs"] = f"WITH s AS (SELECT doc_id, {SAMPLED} FROM documents) SELECT doc_id, CASE WHEN taken = a THEN p WHEN taken = b THEN q END::DOUBLE AS logprob FROM s"


@query
def sampled_logprobs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").selectExpr("doc_id", *[x.strip() for x in SAMPLED.split(", ")])
    taken = arrays.gather(F.array("a", "b"), F.array(F.col("p").cast("double"), F.col("q").cast("double")), F.col("taken"))
    return docs.select("doc_id", F.when(~F.isnan(taken), taken).alias("logprob"))


SQL["completion_differences"] = """WITH s AS (SELECT a.doc_id, a.n_chars AS x, b.n_chars AS y, a.source AS sa, b.source AS sb FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, x % 3 <> y % 3 OR sa IS DISTINCT FROM sb OR abs(x - y) > greatest(1e-5 * greatest(x, y), 1e-6) AS differs FROM s"""


@query
def completion_differences(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    ids = F.array((F.col("n_chars") % 3).cast("string"), F.coalesce("source", F.lit("")))
    each = docs.select("doc_id", ids.alias("ids"), F.array(-F.col("n_chars").cast("double"), F.lit(float("nan"))).alias("p"))
    after = each.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ids").alias("ids2"), F.col("p").alias("p2"))
    met = each.join(after, "doc_id")
    return met.select("doc_id", arrays.completions_differ(F.col("ids"), F.col("ids2"), F.col("p"), F.col("p2")).alias("differs"))


BROKEN = "CASE WHEN conv_id % 5 = 1 THEN '[]' WHEN conv_id % 5 = 2 THEN substr(m, 1, length(m) - 1) WHEN conv_id % 5 = 3 THEN '{\"m\":' || m || '}' ELSE m END"
SQL["release_rows"] = f"""WITH c AS (SELECT conv_id, '[' || string_agg('{{"role":"' || role || '","content":"x"}}', ',' ORDER BY turn, role) || ']' AS m FROM conversations GROUP BY conv_id),
    s AS (SELECT conv_id, {BROKEN} AS t FROM c), d AS (SELECT conv_id, t, CASE WHEN json_valid(t) THEN t END AS j FROM s)
    SELECT conv_id, CASE WHEN j IS NULL THEN 'messages: not JSON' WHEN json_type(j) <> 'ARRAY' THEN 'messages: not a list' WHEN json_array_length(j) = 0 THEN 'messages: empty' END AS reason,
    CASE WHEN json_type(j) = 'ARRAY' THEN json_array_length(j)::INT END AS messages FROM d"""


@query
def release_rows(spark, sf_dir):
    one = F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","content":"x"}'))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", one.alias("j"))))
    made = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["j"]), ","), F.lit("]")).alias("m"))
    rows = made.withColumn("messages", F.expr(BROKEN)).select(
        "conv_id", F.struct(F.concat(F.lit("t"), F.col("conv_id")).alias("task_id")).alias("task_info"), F.lit("conversation").alias("traj_type"), "messages",
        F.lit('[{"name":"f"}, 3]').alias("tools"), F.lit(None).cast("int").alias("steps"),
    )
    parsed = trajectories.parse_release(rows)
    listed = F.col("malformed_reason").isNull() | (F.col("malformed_reason") == "messages: empty")
    return parsed.select("conv_id", F.col("malformed_reason").alias("reason"), F.when(listed, F.size("decoded")).alias("messages"))


SQL["decoded_calls"] = """SELECT event_id, event_type AS name, CASE event_id % 3 WHEN 0 THEN replace(props, ' ', '') WHEN 1 THEN '{"__raw__":"' || event_type || '"}' ELSE '{"__value__":' || event_id || '}' END AS arguments FROM events"""


@query
def decoded_calls(spark, sf_dir):
    made = F.expr("CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN event_type ELSE cast(event_id AS string) END")
    call = F.struct(F.lit(None).cast("struct<name:string,arguments:string>").alias("function"), F.col("event_type").alias("name"), made.alias("arguments"))
    empty = F.lit(None).cast("string")
    message = F.struct(F.lit("assistant").alias("role"), empty.alias("content"), empty.alias("reasoning_content"), empty.alias("name"), F.array(call).alias("tool_calls"))
    first = F.get(trajectories.normalize_message(message)["tool_calls"], 0)
    return read(spark, sf_dir, "events").select("event_id", first["name"].alias("name"), first["arguments"].alias("arguments"))


SQL["state_snapshots"] = """SELECT event_id, '{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS state FROM events"""


@query
def state_snapshots(spark, sf_dir):
    made = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "__class__": 1, "event_type": "'), F.col("event_type"), F.lit('"}'))
    return read(spark, sf_dir, "events").select("event_id", checks.snapshot(made).alias("state"))


#: item, path, op, value of checks on the properties of an event.
CHECKS = (("large", "$.k", "ge", "50"), ("not_seven", "$.k", "ne", "7"), ("there", "$.k", "exists", "null"), ("gone", "$.missing", "eq", "1"), ("odd", "$.k", "like", "1"))
SQL["state_checks"] = """WITH c AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events)
    SELECT event_id, i AS item, CASE i WHEN 'large' THEN k >= 50 WHEN 'not_seven' THEN k <> 7 WHEN 'there' THEN k IS NOT NULL ELSE false END AS passed,
    CASE i WHEN 'gone' THEN 'nothing at $.missing' WHEN 'odd' THEN 'unknown op like' END AS reason FROM c, (VALUES ('large'), ('not_seven'), ('there'), ('gone'), ('odd')) v(i)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    listed = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(c, ("item", "path", "op", "value"), strict=True)]) for c in CHECKS])
    asked = events.select("event_id", F.inline(listed))
    return checks.run_checks(events.select("event_id", F.col("props").alias("state")), asked, ["event_id"])


@query
def state_checks(spark, sf_dir):
    return _checked(spark, sf_dir).select("event_id", "item", "passed", "reason")


SQL["selftest_fractions"] = """WITH c AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events)
    SELECT event_id, ((k >= 50)::INT + (k <> 7)::INT + 1)::BIGINT AS passed, 5::BIGINT AS checks, round(((k >= 50)::INT + (k <> 7)::INT + 1) / 5.0::DOUBLE, 4) AS reward FROM c"""


@query
def selftest_fractions(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    want = F.when(k >= 50, 1).otherwise(0) + F.when(k != 7, 1).otherwise(0) + 1
    known = read(spark, sf_dir, "events").select("event_id", want.cast("long").alias("want"))
    return checks.exact_fractions(_checked(spark, sf_dir).join(known, "event_id"), ["event_id", "want"], F.col("want")).drop("want")


SAID = "CASE WHEN role = 'assistant' THEN '<think>' || role || turn || ' </think>' || chr(10) || text WHEN turn % 3 = 2 THEN '<tool_response>' || text || '</tool_response>' ELSE ' ' || text END"
THOUGHT_OF = "CASE WHEN turn % 4 = 3 THEN ' R' || turn END"
_C = _bare("t")
SQL["history_rendered"] = rf"""
WITH s AS (SELECT conv_id, turn, role, {SAID} AS t, {THOUGHT_OF} AS r FROM conversations), c AS (SELECT *, {_C} AS b FROM s),
a AS (SELECT conv_id, coalesce(max(turn) FILTER (role = 'user' AND NOT (starts_with(b, '<tool_response>') AND ends_with(b, '</tool_response>'))), -1) AS asked FROM c GROUP BY conv_id),
p AS (SELECT conv_id, turn, role, b, asked, CASE WHEN r IS NULL THEN regexp_replace(list_extract(string_split(b, '</think>'), -1), '^\n+', '') ELSE b END AS answer,
  coalesce(r, CASE WHEN strpos(b, '</think>') > 0 THEN list_extract(string_split(list_extract(string_split(b, '</think>'), 1), '<think>'), -1) END, '') AS thought FROM c JOIN a USING (conv_id))
SELECT conv_id, sha256(string_agg(role || ':' || CASE WHEN role <> 'assistant' THEN b WHEN turn > asked THEN '<think>' || chr(10) || {_bare("thought")} || chr(10) || '</think>' || chr(10) || chr(10) || answer ELSE answer END, chr(10) ORDER BY turn)) AS rendered
FROM p GROUP BY conv_id"""


@query
def history_rendered(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.expr(SAID).alias("content"), F.expr(THOUGHT_OF).alias("reasoning_content")).alias("m"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))
    shown = F.transform(trajectories.with_history(F.col("messages")), lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return listed.select("conv_id", F.sha2(F.array_join(shown, "\n").cast("binary"), 256).alias("rendered"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL["tools_announced"] = f"""
WITH t AS (SELECT c_nationkey, string_agg(chr(10) || '{{"name":"' || c_name || '"}}', '' ORDER BY c_name) FILTER (c_acctbal > 0) AS tools FROM customer GROUP BY c_nationkey)
SELECT n_nationkey, sha256(CASE WHEN tools IS NULL THEN n_name ELSE {_quoted(trajectories.TOOLS_HEAD)} || tools || {_quoted(trajectories.TOOLS_TAIL)} || chr(10) || chr(10) || n_name END) AS prompt FROM nation LEFT JOIN t ON c_nationkey = n_nationkey"""


@query
def tools_announced(spark, sf_dir):
    named = F.when(F.col("c_acctbal") > 0, F.concat(F.lit('{"name":"'), "c_name", F.lit('"}')))
    tools = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(named)).alias("tools"))
    met = read(spark, sf_dir, "nation").join(tools, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    listed = F.coalesce("tools", F.array().cast("array<string>"))
    return met.select("n_nationkey", F.sha2(trajectories.tools_prompt(listed, F.concat(F.lit(" "), "n_name")).cast("binary"), 256).alias("prompt"))
