"""Queries of records, batches, plug-ins and the turn engine, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.functions import arrays
from trellium.operators import batching, evaluation, ordered, plugins, records, sweep, telemetry, trajectories, turns
from trellium.plans.queries import _arrays, _events, query, read
from trellium.streaming import metrics, slots

SQL: dict[str, str] = {}
_RECORDS = """d AS (SELECT doc_id, lang, (doc_id % 9 + 1)::INT AS n, list_transform(range(1, doc_id % 9 + 2), lambda x: x::INT) AS ids,
    list_transform(range(1, doc_id % 9 + 2), lambda x: CASE WHEN x % 3 = 0 THEN x ELSE -100 END) AS labels FROM documents)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return trajectories.training_record(_arrays(spark, sf_dir), 2, "full", "t").join(langs, "doc_id")


def _joined(column: str, out: str | None = None):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(out or column)


SQL["shard_features"] = f"WITH {_RECORDS} SELECT 2 AS schema_version, 'full' AS semantics, array_to_string(ids, ',') AS input_ids, n AS seq_length, (n // 3)::INT AS supervised_tokens, n AS length FROM d"


@query
def shard_features(spark, sf_dir):
    return records.features(_records(spark, sf_dir)).select("schema_version", "semantics", _joined("input_ids"), "seq_length", "supervised_tokens", "length")


SQL["shard_statistics"] = "SELECT count(*) AS samples, sum(doc_id % 9 + 1)::BIGINT AS total_tokens, sum((doc_id % 9 + 1) // 3)::BIGINT AS supervised_tokens, round(sum((doc_id % 9 + 1) // 3) / sum(doc_id % 9 + 1), 6) AS supervised_fraction FROM documents"


@query
def shard_statistics(spark, sf_dir):
    return records.shard_stats(_records(spark, sf_dir), 9, 100)


SQL["collated_batches"] = f"""WITH {_RECORDS}, w AS (SELECT *, max(n) OVER (PARTITION BY doc_id // 4) AS wide FROM d)
    SELECT doc_id, array_to_string(list_transform(range(1, wide + 1), lambda i: CASE WHEN i <= n THEN i ELSE 0 END), ',') AS input_ids,
    array_to_string(list_transform(range(1, wide + 1), lambda i: CASE WHEN i <= n AND i % 3 = 0 THEN i ELSE -100 END), ',') AS labels,
    array_to_string(list_transform(range(1, wide + 1), lambda i: CASE WHEN i <= n THEN 1 ELSE 0 END), ',') AS attention_mask FROM w"""


@query
def collated_batches(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 4))
    return records.collate(rows, ["batch"], 0, 9).select("doc_id", _joined("input_ids"), _joined("labels"), _joined("attention_mask"))


SQL["flattened_batches"] = f"""WITH {_RECORDS}, o AS (SELECT *, doc_id // 4 AS batch, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) - 1 AS k FROM d),
    x AS (SELECT batch, doc_id, k, n, unnest(ids) AS id, unnest(labels) AS label, unnest(range(0, n)) AS pos FROM o)
    SELECT batch, string_agg(id::VARCHAR, ',' ORDER BY doc_id, pos) AS input_ids, string_agg(CASE WHEN pos = 0 THEN '-100' ELSE label::VARCHAR END, ',' ORDER BY doc_id, pos) AS labels,
    string_agg(pos::VARCHAR, ',' ORDER BY doc_id, pos) AS position_ids, string_agg(k::VARCHAR, ',' ORDER BY doc_id, pos) AS seq_idx,
    (SELECT '0,' || string_agg(e::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id, sum(n) OVER (ORDER BY doc_id) AS e FROM o b WHERE b.batch = x.batch)) AS cu_seqlens, max(n)::INT AS max_length FROM x GROUP BY batch"""


@query
def flattened_batches(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 4))
    out = records.flatten_batches(rows, ["batch"], ["doc_id"], 64)
    return out.select("batch", *[_joined(c) for c in ("input_ids", "labels", "position_ids", "seq_idx", "cu_seqlens")], "max_length")


SQL["episode_records"] = """SELECT conv_id AS episode_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text)) AS messages, count(*) FILTER (role = 'tool') AS step_count,
    count(*) FILTER (role = 'assistant') AS generation_count, CASE WHEN arg_max(role, (turn, role, text)) = 'assistant' THEN 'final_answer' END AS terminal_reason FROM conversations GROUP BY conv_id"""


@query
def episode_records(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode_id"), "turn", "role", F.col("text").alias("content"))
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return records.episode_rows(said).select("episode_id", F.sha2(lines.cast("binary"), 256).alias("messages"), "step_count", "generation_count", "terminal_reason")


SQL["rollout_batch"] = """SELECT doc_id AS scenario_id, (doc_id % 9 + 1)::INT AS tokens, ((doc_id % 9 + 1) // 3)::INT AS unmasked, quality::DOUBLE AS rollout_reward, lang AS terminal_reason FROM documents JOIN labels USING (doc_id)"""


@query
def rollout_batch(spark, sf_dir):
    rows = _arrays(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    made = rows.select(
        F.array(F.lit(0)).alias("prompt_ids"), F.col("input_ids").alias("completion_ids"), F.transform("mask", lambda m: F.when(m == 1, F.lit(-0.5)).otherwise(F.lit(float("nan")))).alias("logprobs"),
        F.col("mask").alias("env_mask"), F.col("quality").alias("reward"), F.col("doc_id").alias("scenario_id"), F.col("lang").alias("terminal_reason"),
    )
    ones = F.size(F.filter("env_mask", lambda m: m == 1)).alias("unmasked")
    return records.assemble(made).select("scenario_id", F.size("completion_ids").alias("tokens"), ones, "rollout_reward", "terminal_reason")


SQL["positional_zip"] = """WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier), b AS (SELECT s_name, row_number() OVER (ORDER BY s_name DESC, s_suppkey) AS i FROM supplier)
    SELECT (a.i - 1)::BIGINT AS position, s_suppkey, s_name FROM a JOIN b USING (i)"""


@query
def positional_zip(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    backwards = suppliers.join(suppliers.groupBy("s_name").agg(F.count("*").alias("same")), "s_name").select("s_name", F.col("s_suppkey").alias("tie"))
    # names in descending order: by their rank from the end
    names = ordered.numbered(backwards, ["s_name", "tie"], "up").withColumn("down", -F.col("up")).select("s_name", "down")
    return records.zip_positions(suppliers.select("s_suppkey"), names, ["s_suppkey"], ["down"]).select("position", "s_suppkey", "s_name")


SQL["prefix_subset"] = "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 64"


@query
def prefix_subset(spark, sf_dir):
    return records.prefix(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority", "o_orderkey"], 64)


SQL["user_messages"] = "SELECT conv_id, arg_min(text, (turn, role, text)) FILTER (role = 'user') AS first, arg_max(text, (turn, role, text)) FILTER (role = 'user') AS last FROM conversations GROUP BY conv_id"


@query
def user_messages(spark, sf_dir):
    listed = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return listed.select("conv_id", records.first_user(F.col("m")).alias("first"), records.last_user(F.col("m")).alias("last"))


SQL["category_list"] = "SELECT string_agg(lang, ',' ORDER BY lang) AS categories FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)"


@query
def category_list(spark, sf_dir):
    known = ["de", "en", "es", "fr", "it"]
    return records.categories(read(spark, sf_dir, "documents"), "lang", known, "multi_turn").select(F.array_join("categories", ",").alias("categories"))


SQL["turn_partition"] = "SELECT coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false) AS multi_turn, count(*) AS n FROM orders GROUP BY 1"


@query
def turn_partition(spark, sf_dir):
    multi = records.is_multi_turn(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])
    return read(spark, sf_dir, "orders").groupBy(multi.alias("multi_turn")).agg(F.count("*").alias("n"))


_DECIDED = """x AS (SELECT *, count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM events),
    y AS (SELECT event_id, user_id, event_type, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w::BIGINT AS step_count, sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) OVER w::BIGINT AS invalid_call_count,
      last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER w AS tools_in_force, CASE WHEN event_type = 'error' THEN 'done' WHEN event_type = 'click' THEN 'tool' ELSE 'ready' END AS state,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM x WHERE ended = 0 WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
SQL["turn_advances"] = f"WITH {_DECIDED} SELECT event_id, step_count, invalid_call_count, tools_in_force, state FROM y"
SQL["scheduler_events"] = f"""WITH {_DECIDED}, z AS (SELECT event_id, user_id, unnest(list_filter([CASE WHEN nth = 1 THEN 'ready' END, CASE WHEN event_type = 'click' THEN 'observation:tool' END, CASE WHEN state = 'tool' THEN 'step' END,
    CASE WHEN event_type = 'error' THEN 'terminal:error' END, CASE WHEN state = 'done' THEN 'done' END], lambda e: e IS NOT NULL)) AS event FROM y) SELECT event_id AS at, user_id AS episode, event FROM z"""


def _advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    decisions = read(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when(kind == "click", 1).otherwise(0).alias("env_steps"), (F.col("value") < 10).alias("invalid_call"), F.when(kind == "signup", F.col("props")).alias("tools"),
        (kind == "click").alias("pending"), F.when(kind == "error", "error").alias("terminal"), F.when(kind == "click", F.col("props")).alias("observation"), F.lit(None).cast("string").alias("label"),
    )
    return turns.advance(decisions, "user_id", ["event_id"])


@query
def turn_advances(spark, sf_dir):
    return _advanced(spark, sf_dir).select("event_id", "step_count", "invalid_call_count", "tools_in_force", "state")


@query
def scheduler_events(spark, sf_dir):
    advanced = _advanced(spark, sf_dir)
    starts = advanced.groupBy("user_id").agg(F.min("event_id").alias("start"))
    return turns.scheduler_log(advanced.join(starts, "user_id"), "user_id", "event_id", F.col("event_id") == F.col("start"))


SQL["worker_crashes"] = """WITH e AS (SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS position, l_suppkey % 10 AS worker, l_quantity AS opened FROM lineitem), c AS (SELECT DISTINCT s_suppkey % 10 AS worker, round((s_acctbal + 1000) / 250) AS t FROM supplier)
    SELECT position, worker, (SELECT min(t) FROM c WHERE c.worker = e.worker AND t >= opened AND t < opened + 5)::DOUBLE AS crashed_at,
    CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.worker = e.worker AND t >= opened AND t < opened + 5) THEN 'worker_crash' ELSE 'finished' END AS outcome FROM e"""


@query
def worker_crashes(spark, sf_dir):
    """Every line as an episode of five days, and every supplier's balance as one of the many crashes of its worker."""
    episodes = read(spark, sf_dir, "lineitem").select(
        F.expr("(l_orderkey * 10 + l_linenumber) * 1000000L + l_suppkey").alias("position"), F.expr("l_suppkey % 10").alias("worker"), F.lit(0).alias("attempt"), F.col("l_quantity").cast("double").alias("opened"), (F.col("l_quantity") + 5).cast("double").alias("ended")
    )
    crashes = read(spark, sf_dir, "supplier").select(F.expr("s_suppkey % 10").alias("worker"), F.round((F.col("s_acctbal") + 1000) / 250).cast("double").alias("at")).distinct()
    return turns.replaced(crashes, episodes).select("position", "worker", "crashed_at", "outcome")


SQL["rate_ratio"] = """WITH w AS (SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END)::DOUBLE / 86400, 9) AS hits, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS c, round(count(*)::DOUBLE / 86400, 9) AS queries FROM events GROUP BY 1)
    SELECT day, round(hits / queries, 6) AS ratio FROM w"""


@query
def rate_ratio(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("increase"))
    hits = metrics.windowed_rate(events.where("event_type = 'purchase'"), "ts", "1 day", 86400.0)
    ratio = metrics.rate_ratio(hits, metrics.windowed_rate(events, "ts", "1 day", 86400.0))
    return ratio.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "ratio")


SQL["rendered_by_name"] = """SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn, role, text)) AS content FROM conversations GROUP BY conv_id"""


@query
def rendered_by_name(spark, sf_dir):
    listed = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return plugins.rendered(listed, "content").select("conv_id", F.sha2(F.col("rendered").cast("binary"), 256).alias("content"))


_ANSWERED = "q AS (SELECT c_custkey AS task_id, c_mktsegment AS category, n_name AS answer, CASE WHEN c_acctbal < 0 THEN '' WHEN n_regionkey = 1 THEN n_name ELSE c_mktsegment END AS reply FROM customer JOIN nation ON c_nationkey = n_nationkey)"
SQL["adapter_summary"] = f"""WITH {_ANSWERED} SELECT category, count(*) AS n_tasks, round(avg((reply = answer)::INT), 6) AS score, round(avg(length(reply)), 6) AS avg_tokens, round(sum((reply = '')::INT) / count(*), 6) AS invalid_call_rate FROM q GROUP BY category"""


@query
def adapter_summary(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    questions = customers.select(F.col("c_custkey").alias("task_id"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("question"), F.col("n_name").alias("answer"))
    reply = F.when(F.col("c_acctbal") < 0, "").when(F.col("n_regionkey") == 1, F.col("n_name")).otherwise(F.col("c_mktsegment"))
    script = customers.select(F.col("c_custkey").alias("task_id"), reply.alias("reply"), F.lit(1).alias("turn"))

    def backend(prompts: DataFrame) -> DataFrame:
        return plugins.scripted(prompts.withColumn("turn", F.lit(1)), script, ["task_id", "turn"])

    return plugins.run(plugins.Exact(questions, "r1"), backend).select("category", "n_tasks", "score", "avg_tokens", "invalid_call_rate")


_STAGES = (("click", "generation"), ("view", "env.step"), ("error", "verifier"), ("purchase", "parse"), ("signup", "tokenization"))
SQL["stage_rows"] = f"""WITH s AS (SELECT CASE event_type {" ".join(f"WHEN '{e}' THEN '{s}'" for e, s in _STAGES)} END AS stage, value FROM events)
    SELECT stage, round(sum(value), 2) AS total_s, count(*) AS calls, max(value) AS max_s FROM s WHERE stage IS NOT NULL GROUP BY stage UNION ALL SELECT 'scheduling', round(1e9 - sum(value), 2), 7, 0 FROM s WHERE stage IS NOT NULL"""


@query
def stage_rows(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for pair in _STAGES for x in pair])
    samples = read(spark, sf_dir, "events").select(names[F.col("event_type")].alias("stage"), F.col("value").alias("seconds")).where("stage is not null")
    none = spark.createDataFrame([], "stage string, start double, end double")
    return telemetry.stage_table(samples, none, 1e9, 7).select("stage", F.round("total_s", 2).alias("total_s"), "calls", "max_s")


SQL["depth_series"] = """WITH i AS (SELECT event_type, floor(epoch_us(ts) / 1e6) AS a, floor(floor(epoch_us(ts) / 1e6) + value * 60) AS b FROM events),
    s AS (SELECT event_type, a AS t, 1 AS delta FROM i UNION ALL SELECT event_type, b, -1 FROM i), g AS (SELECT event_type, t, delta, sum(delta) AS change FROM s GROUP BY ALL),
    d AS (SELECT event_type, t, delta, sum(change) OVER (PARTITION BY event_type ORDER BY t, delta) AS depth, row_number() OVER (PARTITION BY event_type ORDER BY t DESC, delta DESC) AS n FROM g)
    SELECT event_type, round(avg(depth), 6) AS mean, max(depth)::BIGINT AS peak, string_agg(depth::BIGINT::VARCHAR, ',' ORDER BY t, delta) FILTER (n <= 16) AS last FROM d GROUP BY event_type"""


@query
def depth_series(spark, sf_dir):
    spans = _events(spark, sf_dir).withColumn("at", F.floor("at")).withColumn("end", F.floor(F.col("at") + F.col("value") * 60))
    found = telemetry.depth_summary(telemetry.queue_depth(spans, ["event_type"], "at", "end"), ["event_type"])
    return found.select("event_type", "mean", "peak", _joined("last"))


SQL["reopened_prefixes"] = """WITH p AS (SELECT conv_id, turn, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b FROM conversations),
    c AS (SELECT conv_id, turn, a, b, (SELECT coalesce(min(i) - 1, least(length(a), length(b))) FROM range(1, least(length(a), length(b)) + 1) t(i) WHERE a[i] <> b[i])::INT AS n FROM p WHERE b IS NOT NULL)
    SELECT conv_id, turn, CASE WHEN length(b) = n THEN 'clean' WHEN n >= 20 AND length(b) - n < 1024 THEN 'realign' ELSE 'fork' END AS kind, (length(b) - n)::INT AS drift,
    CASE WHEN n < length(b) AND n < 10 THEN n ELSE 10 END AS boundary, sha256(a) AS tokens, (SELECT count(*) FROM (VALUES (0), (10)) v(s) WHERE s < n OR (length(b) = n)) + (length(a) > n)::INT AS spans FROM c"""


@query
def reopened_prefixes(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    both = read(spark, sf_dir, "conversations").withColumn("b", F.lag("text").over(w)).where("b is not null")
    held = F.split("b", "")
    kind = "struct<start:int,end:int,supervised:boolean>"
    spans = F.array(
        F.struct(F.lit(0).alias("start"), F.lit(10).alias("end"), F.lit(False).alias("supervised")).cast(kind),
        F.struct(F.lit(10).alias("start"), F.size(held).alias("end"), F.lit(True).alias("supervised")).cast(kind),
    )
    made = both.select("conv_id", "turn", arrays.reopened(held, spans, F.lit(10), F.split("text", ""), F.lit(20)).alias("r"))
    return made.select("conv_id", "turn", "r.kind", "r.drift", "r.boundary", F.sha2(F.array_join("r.tokens", "").cast("binary"), 256).alias("tokens"), F.size("r.spans").cast("long").alias("spans"))


SQL["resumed_epochs"] = "SELECT l_linenumber AS epoch, l_orderkey AS batch FROM lineitem WHERE l_linenumber > 2 OR (l_linenumber = 2 AND l_orderkey >= 100)"


@query
def resumed_epochs(spark, sf_dir):
    batches = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("epoch"), F.col("l_orderkey").alias("batch"))
    return batching.resume(batches, 100, epoch=2)


SQL["hashed_tokens"] = r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS tokens FROM documents"""


@query
def hashed_tokens(spark, sf_dir):
    return trajectories.tokenized(read(spark, sf_dir, "documents"), trajectories.hashed_words()).select("doc_id", F.size("input_ids").alias("tokens"))


# Guards on what the tables hold.

SQL["single_manifest"] = "WITH n AS (SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1) SELECT r_name, nations FROM region JOIN n ON r_regionkey = n_regionkey"


@query
def single_manifest(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("nations"))
    return sweep.assert_single(read(spark, sf_dir, "region").join(nations, "r_regionkey").select("r_name", "nations"), "nations")


SQL["epoch_order"] = "SELECT p_partkey, (row_number() OVER (ORDER BY md5(p_partkey || ':7'), p_partkey) - 1)::BIGINT AS position FROM part"


@query
def epoch_order(spark, sf_dir):
    parts = batching.epoch_key(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 5, 2)
    return ordered.numbered(parts, ["epoch_key", "p_partkey"]).select("p_partkey", "position")


SQL["comparable_keys"] = """SELECT coalesce(s_suppkey, c_custkey)::VARCHAR AS key, s_nationkey AS left, c_nationkey AS right FROM supplier FULL JOIN customer ON s_suppkey = c_custkey WHERE s_nationkey IS DISTINCT FROM c_nationkey"""


@query
def comparable_keys(spark, sf_dir):
    a = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_nationkey").alias("value"))
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_nationkey").alias("value"))
    return evaluation.comparable(a, b)


SQL["equivalence_diff"] = """WITH a AS (SELECT l_orderkey, max(l_linenumber)::DOUBLE AS l, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY 1),
    b AS (SELECT l_orderkey, max(CASE WHEN l_linestatus = 'F' THEN l_linenumber END)::DOUBLE AS r, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
    j AS (SELECT l_orderkey, l, r, a.lines AS x, b.lines AS y, b.l_orderkey IS NULL AS gone FROM a LEFT JOIN b USING (l_orderkey))
    SELECT l_orderkey, 'only_left' AS problem FROM j WHERE y IS NULL UNION ALL SELECT l_orderkey, 'reward' FROM j WHERE y IS NOT NULL AND (r IS NULL OR abs(l - r) > 1e-9) UNION ALL SELECT l_orderkey, 'lines' FROM j WHERE y IS NOT NULL AND x <> y"""


@query
def equivalence_diff(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    listed = F.array_sort(F.collect_list("l_linenumber")).alias("lines")
    a = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("double").alias("reward"), listed)
    kept = lines.where("l_returnflag <> 'R'")
    b = kept.groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linestatus") == "F", F.col("l_linenumber"))).cast("double").alias("reward"), listed)
    return evaluation.equivalence(a, b, "l_orderkey", "reward", lists=["lines"]).select("l_orderkey", "problem")


SQL["snapshot_delta"] = "SELECT event_type AS name, count(*) FILTER (ts >= TIMESTAMP '2024-01-15')::DOUBLE AS delta FROM events GROUP BY 1"


@query
def snapshot_delta(spark, sf_dir):
    from trellium.sources import files

    events = read(spark, sf_dir, "events").withColumn("name", F.col("event_type"))
    total = F.count("*").cast("double").alias("total")
    return files.snapshot_delta(events.where("ts < timestamp '2024-01-15'").groupBy("name").agg(total), events.groupBy("name").agg(total))


SQL["resume_guard"] = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'"


@query
def resume_guard(spark, sf_dir):
    from trellium.operators import guards

    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("profile"), F.lit(None).cast("string").alias("dtype"))
    return guards.resumable(rows, {"profile": "F", "dtype": None}, "5-LOW").select("o_orderkey")


SQL["episode_slots"] = """WITH e AS (SELECT o_orderkey AS position, o_custkey AS worker, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS opened FROM orders),
    x AS (SELECT e.*, c.hit FROM e LEFT JOIN (SELECT c_custkey, floor((c_acctbal + 1000) / 5)::DOUBLE AS hit FROM customer) c ON c_custkey = worker AND hit >= opened AND hit < opened + 30)
    SELECT worker::VARCHAR AS worker, position, 0 AS attempt, position::VARCHAR AS episode_id, NULL::VARCHAR AS replaced_episode_id, opened, coalesce(hit, opened + 30) AS ended,
      CASE WHEN hit IS NULL OR hit >= opened + 2 THEN 1 ELSE 0 END::BIGINT AS step_count, CASE WHEN hit IS NULL OR hit >= opened + 1 THEN 1 ELSE 0 END::BIGINT AS generation_count,
      CASE WHEN hit IS NULL THEN 'final_answer' ELSE 'worker_crash' END AS terminal_reason FROM x
    UNION ALL SELECT worker::VARCHAR, position, 1, position || '~1', position::VARCHAR, hit, hit + 30, 0, 0, 'final_answer' FROM x WHERE hit IS NOT NULL"""


@query
def episode_slots(spark, sf_dir):
    """Orders as episodes of 30 days held by their customer, whose one crash replaces those that are open then."""
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("worker"), F.col("o_orderkey").alias("position"), F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("opened")
    )
    crashes = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("worker"), F.floor((F.col("c_acctbal") + 1000) / 5).cast("double").alias("at"))
    hit = orders.join(crashes, "worker").where("at >= opened and at < opened + 30")
    first = orders.select("worker", "position", F.lit(0).alias("attempt"), "opened", (F.col("opened") + 30).alias("ended"), F.lit("final_answer").alias("reason"))
    second = hit.select("worker", "position", F.lit(1).alias("attempt"), F.col("at").alias("opened"), (F.col("at") + 30).alias("ended"), F.lit("final_answer").alias("reason"))

    def moved(event: str, after: int):
        return orders.select("worker", (F.col("opened") + after).alias("at"), F.lit(1).alias("seq"), F.lit(event).alias("event"), "position", F.lit(0).alias("attempt"))

    events = slots.feed(first.unionByName(second), crashes).unionByName(moved("generate", 1)).unionByName(moved("call", 2))
    return slots.episode_slots(events, 1e9).drop("invalid_call_count", "stage_timings")


_SPOKEN = """u AS (SELECT conv_id, turn, role, text, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: length(w)::INT) AS ids FROM conversations),
    k AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last, min(turn) FILTER (role = 'user') AS asked FROM u GROUP BY conv_id)"""
SQL["sft_records"] = f"""WITH {_SPOKEN},
    r AS (SELECT conv_id, flatten(list(ids ORDER BY turn)) AS ids, flatten(list(CASE WHEN role = 'assistant' THEN ids ELSE list_transform(ids, lambda x: -100) END ORDER BY turn)) AS labels,
      (SELECT count(*) FROM u x JOIN k y USING (conv_id) WHERE x.conv_id = u.conv_id AND x.turn > y.last) AS cut FROM u JOIN k USING (conv_id) WHERE last > asked AND turn <= last GROUP BY conv_id)
    SELECT 2 AS schema_version, 'reasoning' AS semantics, 'c' || conv_id AS trajectory_uid, conv_id::VARCHAR AS task_id, 'env' || conv_id % 7 AS env_id, 'full' AS mode, array_to_string(ids, ',') AS input_ids,
      array_to_string(labels, ',') AS labels, len(ids)::INT AS seq_length, len(list_filter(labels, lambda x: x <> -100))::INT AS supervised_tokens, 't1' AS template_fingerprint, cut::INT AS trailing_messages_removed
    FROM r WHERE len(list_filter(labels, lambda x: x <> -100)) > 0"""


@query
def sft_records(spark, sf_dir):
    """Conversations as training records; the length of a word stands for its token."""
    uid = F.concat(F.lit("c"), "conv_id").alias("trajectory_uid")
    turns = read(spark, sf_dir, "conversations").select(uid, "conv_id", "turn", "role", "text")
    about = turns.select("trajectory_uid", F.col("conv_id").cast("string").alias("task_id"), F.concat(F.lit("env"), F.expr("conv_id % 7")).alias("env_id")).distinct()
    lengths = lambda text: F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.length)
    made = trajectories.sft_records(turns.drop("conv_id"), about, lengths, 2, "reasoning", "full", "t1")
    return made.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("input_ids", "labels")})


SQL["trajectory_rows"] = """WITH s AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn > 0 THEN 'tool' ELSE role END AS role, text FROM conversations)
    SELECT conv_id::VARCHAR AS episode_id, 's' || conv_id % 5 AS scenario_id, (conv_id % 3)::INT AS group_index, sha256(string_agg(role || ':' || text || ':' || CASE WHEN role = 'assistant' THEN upper(role) ELSE '' END, chr(10) ORDER BY turn)) AS messages,
      sha256(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'tool'), '')) AS observations, count(*) FILTER (role = 'tool') AS step_count, count(*) FILTER (role = 'assistant') AS generation_count,
      count(*) FILTER (role = 'assistant' AND length(text) % 2 = 0) AS invalid_call_count, CASE WHEN conv_id % 4 = 0 THEN 'timeout' ELSE 'final_answer' END AS terminal_reason, NULL::VARCHAR AS replaced_episode_id,
      (conv_id % 4)::DOUBLE / 4 AS reward, 0 AS checks, 2 AS stages FROM s GROUP BY conv_id"""


@query
def trajectory_rows(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("episode_id"), "conv_id", "turn", F.when((F.col("role") == "user") & (F.col("turn") > 0), "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content")
    )
    own = F.col("role") == "assistant"
    turns = said.withColumns({"reasoning_content": F.when(own, F.upper("role")), "tool_calls": F.lit(None).cast("string"), "invalid": own & (F.length("content") % 2 == 0)}).drop("conv_id")
    none = F.lit(None)
    episodes = said.select("episode_id", "conv_id").distinct().select(
        "episode_id", F.concat(F.lit("s"), F.expr("conv_id % 5")).alias("scenario_id"), F.expr("cast(conv_id % 3 as int)").alias("group_index"), F.when(F.col("conv_id") % 4 == 0, "timeout").otherwise("final_answer").alias("terminal_reason"),
        none.cast("string").alias("replaced_episode_id"), (F.col("conv_id") % 4 / 4.0).cast("double").alias("reward"), none.cast("array<boolean>").alias("per_check_bools"), F.struct(F.lit(0).alias("clean")).alias("drift"),
        F.expr("map('ready', array(1D), 'tool', array(2D))").alias("stage_timings"),
    )
    rows = records.trajectory_rows(turns, episodes)
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"], F.lit(":"), F.coalesce(m["reasoning_content"], F.lit("")))), "\n")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "episode_id", "scenario_id", "group_index", digest(lines).alias("messages"), digest(F.array_join("observations", "\n")).alias("observations"), "step_count", "generation_count", "invalid_call_count",
        "terminal_reason", "replaced_episode_id", "reward", F.size("per_check_bools").alias("checks"), F.size("stage_timings").alias("stages"),
    )
