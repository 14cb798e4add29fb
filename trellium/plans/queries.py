"""One query per operator, over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellium.functions import arrays, python_calls, text, toolcalls
from trellium.operators import batching, evaluation, guards, sweep, telemetry, trajectories, turns as replays
from trellium.sources import files
from trellium.streaming import calls, metrics

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sweeps: lineitem rows stand for runs.


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("precision"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("config"),
        F.col("l_extendedprice").alias("throughput"), F.col("l_quantity").alias("latency"), F.col("l_orderkey").alias("repetition"),
        F.when(F.col("l_discount") > 0.09, 1).otherwise(0).alias("failed"), F.lit(0).alias("preemptions"),
    )


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sweep.points(_runs(spark, sf_dir), ["precision", "flag", "config"], ["throughput", "latency"])
    return made.withColumn("throughput", F.round("med_throughput", 4)).withColumn("latency", F.round("med_latency", 4))


@query
def sweep_points(spark, sf_dir):
    return _points(spark, sf_dir).select("precision", "flag", "config", "n_runs", "throughput", "min_throughput", "max_throughput", "latency")


@query
def sweep_validity(spark, sf_dir):
    return _points(spark, sf_dir).select("precision", "flag", "config", "reason", "valid")


@query
def pareto_frontier(spark, sf_dir):
    return sweep.pareto(_points(spark, sf_dir).select("precision", "flag", "config", "throughput", "latency"), "throughput", "latency", ["precision"])


@query
def matched_uplift(spark, sf_dir):
    return sweep.matched_uplift(_points(spark, sf_dir), ["flag", "config"], "precision", "O", "F", "throughput").select("flag", "config", "uplift")


@query
def uplift_summary(spark, sf_dir):
    return sweep.uplift_summary(matched_uplift(spark, sf_dir))


@query
def select_profiles(spark, sf_dir):
    points = _points(spark, sf_dir).withColumn("requests", F.col("n_runs")).withColumn("ttft", F.col("latency")).withColumn("tpot", F.round("min_throughput", 2))
    return sweep.profiles(points, ties=("precision", "flag", "config")).select("profile", "precision", "flag", "config", "throughput", "latency")


@query
def eligible_points(spark, sf_dir):
    points = _points(spark, sf_dir).withColumn("valid", F.lit(True)).withColumn("ttft", F.col("latency")).withColumn("tpot", F.col("config"))
    return sweep.eligible(points, 25.0, 4).select("precision", "flag", "config", "latency")


@query
def admission_limits(spark, sf_dir):
    p95 = telemetry.nearest_rank(read(spark, sf_dir, "documents"), ["lang"], "n_chars").withColumn("seqs", F.lit(18))
    return p95.select("lang", sweep.admission_limits(F.col("seqs"), 0.25, F.col("p")).alias("x")).select("lang", "x.*")


# Evaluation: labelled documents stand for tasks.


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").drop("text"), read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("lang").alias("category"), F.coalesce("quality", F.lit(0)).cast("double").alias("score"),
        F.coalesce("toxic", F.lit(0)).alias("invalid_calls"), F.expr("cast(n_chars % 7 as int)").alias("steps"), F.col("n_chars").alias("generated_tokens"),
        (F.col("n_chars") > 4000).alias("truncated"), F.col("quality").cast("boolean").alias("exact_success"), "quality", "toxic",
    )


@query
def category_metrics(spark, sf_dir):
    return evaluation.category_metrics(_tasks(spark, sf_dir))


@query
def overall_rollup(spark, sf_dir):
    return evaluation.overall(_tasks(spark, sf_dir)).select("category", "n_tasks", "score", "avg_tokens")


@query
def sparse_diagnostics(spark, sf_dir):
    keys = F.map_filter(F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double")), lambda k, v: v.isNotNull())
    return evaluation.sparse_means(_tasks(spark, sf_dir).withColumn("diagnostics", keys))


@query
def terminal_rates(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    last = telemetry.last_by(events, ["user_id"], "event_type", ["ts", "event_id"])
    return evaluation.terminal_rates(last.select(F.expr("cast(user_id % 3 as string)").alias("category"), F.col("event_type").alias("terminal_reason")))


@query
def group_variance(spark, sf_dir):
    return evaluation.group_variance(read(spark, sf_dir, "events"), "user_id", "value")


@query
def checklist_reward(spark, sf_dir):
    checks = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("passed"), F.when(F.col("l_linestatus") == "F", "NameError").alias("error_type"))
    return evaluation.checklist_reward(checks, ["l_orderkey"])


@query
def bag_containment(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    return evaluation.bag_contained(items.where("l_linenumber <= 2"), items.where("l_linenumber >= 2"), ["l_orderkey"], "l_returnflag")


@query
def running_mean(spark, sf_dir):
    return evaluation.running_mean(read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), ["ts", "event_id"], "value", ["user_id"]).select("event_id", "running_mean")


@query
def expected_set(spark, sf_dir):
    nations, suppliers = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    return evaluation.expect_set(suppliers.select(F.col("s_nationkey").alias("k")).distinct(), nations.select(F.col("n_regionkey").alias("k")).distinct(), ["k"])


@query
def comparison_table(spark, sf_dir):
    tasks = _tasks(spark, sf_dir).withColumn("tag", F.expr("if(doc_id % 2 = 0, 'even', 'odd')"))
    return evaluation.comparison_table(evaluation.category_metrics(tasks, ["category", "tag"]), ["even", "odd"], "score")


@query
def budget_share(spark, sf_dir):
    return evaluation.budget_share(_tasks(spark, sf_dir), [1, 2, 4, 6])


@query
def task_verdicts(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    shaped = turns.groupBy(F.col("conv_id").alias("task_id"), "turn").agg(F.max("role").alias("role"), F.max(F.length("text")).alias("n")).select(
        "task_id", "turn", (F.col("n") > 20).alias("completed"), F.lit(6).alias("expected_turns"), (F.col("n") % 5 != 0).alias("state_match"), (F.col("n") % 3 != 0).alias("result_match")
    )
    return evaluation.task_verdict(shaped)


# Percentiles, telemetry.


@query
def nearest_rank_p95(spark, sf_dir):
    return telemetry.nearest_rank(read(spark, sf_dir, "documents"), ["lang"], "n_chars")


@query
def rounded_index_percentile(spark, sf_dir):
    return telemetry.rounded_index(read(spark, sf_dir, "documents"), ["lang"], "n_chars", 50)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros)


@query
def episode_walls(spark, sf_dir):
    walls = telemetry.episode_walls(_events(spark, sf_dir), "user_id", "at", "event_type", "signup", "purchase", ["event_id"])
    return walls.select("event_id", "user_id", F.round("wall_s", 3).alias("wall_s"))


@query
def stage_union(spark, sf_dir):
    spans = _events(spark, sf_dir).withColumn("end", F.col("at") + F.col("value") * 60)
    out = telemetry.union_duration(spans, ["event_type"], "at", "end")
    return out.select("event_type", F.round("busy", 1).alias("busy"), F.round("total", 1).alias("total"), "calls", F.round("longest", 3).alias("longest"))


@query
def queue_depth(spark, sf_dir):
    spans = _events(spark, sf_dir).withColumn("at", F.floor("at")).withColumn("end", F.floor(F.col("at") + F.col("value") * 60))
    depth = telemetry.queue_depth(spans, ["event_type"], "at", "end")
    return depth.groupBy("event_type").agg(F.max("depth").alias("peak"), F.count("*").alias("changes"), F.sum("change").alias("net"))


@query
def drift_tally(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("clean"), F.length("l_returnflag").cast("long").alias("forked"), F.col("l_quantity").alias("drift_max"))
    return telemetry.drift_tally(rows, ["clean", "forked"], "drift_max")


@query
def utilization(spark, sf_dir):
    return telemetry.utilization(read(spark, sf_dir, "lineitem"), "l_quantity")


@query
def sampled_table(spark, sf_dir):
    return telemetry.sampled_table(read(spark, sf_dir, "conversations"), ["turn", "role", "text"], ["text"], 2, ["conv_id"])


@query
def long_metrics(spark, sf_dir):
    return telemetry.long_metrics(category_metrics(spark, sf_dir).select("category", "score", "avg_tokens"), ["category"], "eval")


@query
def throughput_meter(spark, sf_dir):
    days = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("tokens"), F.count_distinct("o_custkey").alias("seconds"))
    return telemetry.throughput_meter(days, "day", "tokens", "seconds").select(F.col("day").cast("string").alias("day"), "tokens_per_s", "s_per_mtok", "running_tokens")


# Trajectories.


@query
def trim_conversations(spark, sf_dir):
    kept = trajectories.trim_after_last_assistant(read(spark, sf_dir, "conversations"))
    return kept.groupBy("conv_id").agg(F.count("*").alias("kept"), F.max("removed").alias("removed"))


@query
def loss_mask(spark, sf_dir):
    return trajectories.mask_counts(read(spark, sf_dir, "conversations"))


@query
def conversion_accounting(spark, sf_dir):
    return trajectories.accounting(trajectories.convert_or_skip(loss_mask(spark, sf_dir), 600))


@query
def rendered_turns(spark, sf_dir):
    ordered = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return ordered.select("conv_id", F.sha2(trajectories.render(trajectories.template_messages(messages)).cast("binary"), 256).alias("rendered"))


@query
def prefix_drift(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    chars = turns.withColumn("a", F.split("text", "")).withColumn("b", F.split(F.lag("text").over(w), "")).where("b is not null")
    n = arrays.common_prefix(F.col("a"), F.col("b"))
    return chars.select("conv_id", "turn", n.alias("common"), arrays.classify_drift(F.size("b"), n, F.lit(1)).alias("drift"))


# Batching.


@query
def pack_batches(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    packed = batching.pack(docs, ["lang"], ["doc_id"], "n_chars", 40000, alone=True)
    return batching.padding_saved(packed, ["lang", "batch"], "n_chars")


@query
def rotate_sampler(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("idx"))
    return batching.rotated(parts, parts.count(), 37, 8, 2, 3).select("idx", "chunk", "round", "copy")


@query
def whole_groups(spark, sf_dir):
    return batching.whole_groups(read(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], 7)


@query
def flatten_offsets(spark, sf_dir):
    return batching.flatten(read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n")), ["conv_id"], "turn", "n").groupBy("conv_id").agg(
        F.max("ends").alias("cu_seqlen"), F.max("n").alias("max_len")
    )


# Text functions.


@query
def tool_call_roundtrip(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "props")
    call = toolcalls.serialize_call(F.col("event_type"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")))
    back = toolcalls.parse_calls(F.concat(F.lit("text before "), call))
    first = events.select("event_id", F.get(back, 0).alias("c"))
    return first.select("event_id", F.col("c.name").alias("name"), F.col("c.arguments")["k"].alias("k"))


@query
def redact_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.redact_endpoint(F.col("url")).alias("endpoint"))


@query
def user_turns(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return turns.groupBy("role").agg(F.count_if(text.is_user_turn(F.col("role"), F.col("text"))).alias("user_turns"), F.count("*").alias("n"))


@query
def dedup_exact(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(text.sha256(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


# Metrics.


@query
def metric_rate(spark, sf_dir):
    samples = read(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    raised = metrics.counter_increases(samples, ["event_type"], ["ts", "event_id"], "value")
    rate = metrics.windowed_rate(raised.withColumn("increase", F.round(F.col("increase") * 100).cast("long")), "ts", "1 day", 86400.0, ["event_type"])
    return rate.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "rate")


@query
def gauge_window(spark, sf_dir):
    samples = read(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    return metrics.windowed_gauge(samples, "ts", "1 day", "value", ["event_type"]).select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "peak", "n")


@query
def histogram_quantile(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    bounds = F.array(*[F.lit(x) for x in (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 1000.0)])
    each = events.select("event_type", F.explode(F.filter(bounds, lambda b: b >= F.col("value"))).alias("le"))
    buckets = each.groupBy("event_type", "le").agg(F.count("*").alias("cumulative"))
    return metrics.histogram_quantile(buckets, ["event_type"], "le", "cumulative", 0.95)


@query
def prometheus_sum(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    line = F.concat(F.lit("events_"), F.col("event_type"), F.lit('{user="'), F.col("user_id"), F.lit('"} '), F.floor("value"))
    lines = events.select(line.alias("value")).unionByName(spark.range(1).select(F.lit("# HELP events").alias("value")))
    return files.metric_sums(files.metric_samples(lines))


# Joins, sets and windows of the supporting surface.


@query
def star_join(spark, sf_dir):
    orders, customers, nations, regions = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("largest"))


@query
def missing_dimension(spark, sf_dir):
    return read(spark, sf_dir, "nation").join(read(spark, sf_dir, "supplier").where("s_acctbal > 5000"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_nationkey", "n_name")


@query
def status_cube(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.max("l_quantity").alias("largest"))


@query
def session_windows(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = metrics.sessions(events, "user_id", "ts", "1 hour", "1 day")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


# Guards, replays and records.


@query
def held_out_tools(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").withColumnRenamed("role", "name")
    held = said.groupBy("conv_id", "name").agg(F.min("turn").alias("hold_turn"))
    return guards.visible_tools(said.select("conv_id", "turn").distinct(), said.select("conv_id", "name").distinct(), held, "conv_id").select("conv_id", "turn", "name")


@query
def generation_ready(spark, sf_dir):
    slots = read(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_returnflag") != "R").alias("admitted"), F.when(F.col("l_linestatus") == "O", "ready").otherwise("tool").alias("state"),
        F.lit(None).cast("string").alias("terminal_reason"), F.col("l_linenumber").alias("generation_count"), F.col("l_quantity").alias("step_count"), F.col("l_partkey").alias("prefix"),
    )
    chosen = guards.select_ready(slots, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], 4, 6, 45, 180, 8)
    return chosen.groupBy("l_suppkey", "decision").agg(F.count("*").alias("n"))


@query
def text_binding(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return guards.bind_by_text(docs, docs.groupBy("text").agg(F.min("doc_id").alias("task_id")), "text", ["doc_id"], 4)


@query
def dimension_lookup(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return guards.looked_up(read(spark, sf_dir, "orders"), customers, ["o_custkey"]).select("o_orderkey", "c_nationkey")


@query
def token_budgets(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", guards.token_budget(F.col("n_chars"), 512, 4096, 8).alias("budget"))


@query
def eval_boundaries(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(guards.is_boundary(F.col("o_orderkey"), 50, F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query
def mute_groups(spark, sf_dir):
    episodes = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("terminal_reason"), F.when(F.col("l_quantity") > 20, F.col("l_linenumber")).otherwise(0).alias("generation_count"))
    return guards.nothing_generated(episodes, ["l_orderkey"]).withColumn("reasons", F.array_join("reasons", ","))


@query
def cap_messages(spark, sf_dir):
    fields = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("field"), F.col("p_size").alias("value"))
    return guards.cap_violations(fields, fields.select("field", F.lit(40).alias("cap")))


@query
def turn_replay(spark, sf_dir):
    responses = read(spark, sf_dir, "events").withColumn("has_call", F.col("event_type") != "purchase")
    return replays.replay(responses, "user_id", ["ts", "event_id"], "has_call", 5).select("event_id", "task_turn", "step", "terminal_reason")


@query
def admission_window(spark, sf_dir):
    tasks = read(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("n"))
    return replays.admit(tasks, ["user_id"], ["event_id"], "n", 3).select("event_id", "starts", "ends")


@query
def call_outcomes(spark, sf_dir):
    """Orders as calls, their first shipment as the reply, and customers as workers that are lost on a day."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), "o_custkey", F.to_timestamp("o_orderdate").alias("at"))
    first = F.min(F.struct("l_shipdate", "l_linenumber", "l_returnflag")).alias("f")
    received = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(first)
    reply = F.concat(F.when(F.col("f.l_returnflag") == "R", F.lit("Error during execution: ")).otherwise(F.lit("")), F.col("f.l_returnflag"))
    replies = received.select("call_id", F.to_timestamp("f.l_shipdate").alias("at"), reply.alias("reply"))
    lost = read(spark, sf_dir, "customer").select("c_custkey", F.to_timestamp(F.date_add(F.lit("1992-01-01").cast("date"), F.floor((F.col("c_acctbal") + 1000) / 5).cast("int"))).alias("died"))
    held = orders.join(lost, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("died") >= F.col("at"))).groupBy("c_custkey", "died").agg(F.collect_list("call_id").alias("lost"))
    signalled = calls.first_signals(calls.signals(replies, held.select("lost", F.col("died").alias("at"))))
    return calls.outcomes(orders.drop("o_custkey"), signalled, "40 days").select("call_id", "outcome")


@query
def system_prompts(spark, sf_dir):
    rules = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("rules"))
    return read(spark, sf_dir, "region").join(rules, "r_regionkey").select("r_name", replays.system_prompt(F.lit("Act."), "\n", F.col("r_name"), F.col("rules")).alias("prompt"))


@query
def results_covered(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return replays.covered(lines.where("l_quantity > 10"), lines.where("l_quantity < 40"), "l_orderkey", "l_linenumber", "l_returnflag")


@query
def eval_records(spark, sf_dir):
    tasks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), "lang")
    episodes = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("task_id"), (F.col("vec_id") / F.lit(7.0)).alias("wall_s"), F.lit("final_answer").alias("terminal_reason"))
    verdicts = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id"), F.col("quality").cast("double").alias("score"))
    return replays.eval_record(tasks, episodes, verdicts)


@query
def study_points(spark, sf_dir):
    """The points of each supplier's study."""
    points = replays.study_points(["bf16", "fp8"], [(32, 4096), (64, 8192), (128, 16384)], ["precision", "seqs", "tokens"])
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.inline(points))


@query
def ladder_lookup(spark, sf_dir):
    runs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), *[F.col(c).alias(n) for c, n in (("l_linestatus", "precision"), ("l_returnflag", "flag"), ("l_linenumber", "config"))])
    found = guards.looked_up(runs, _points(spark, sf_dir).select("precision", "flag", "config", "throughput", "latency"), ["precision", "flag", "config"])
    return found.select("run", "config", "throughput", "latency")


@query
def strict_rows(spark, sf_dir):
    task = F.regexp_extract("props", "[0-9]*[13579]\\b", 0)
    parsed = read(spark, sf_dir, "events").withColumn("malformed_reason", F.when(task == "", "no odd number").when(F.col("event_type").contains("c"), "no task"))
    return guards.valid_rows(parsed).select("event_id")


@query
def scenario_checks(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("task_id"))
    made = lines.agg(F.collect_list("l_returnflag").alias("checklist")).withColumns({"env_id": F.lit("e"), "env_class_name": F.lit("E")})
    return guards.scenarios(made).select("task_id", F.size("checklist").alias("checks"))


@query
def logp_stops(spark, sf_dir):
    logged = F.when(F.col("event_id") % 20 == 0, F.lit(float("nan"))).when(F.col("event_id") % 10 != 0, F.col("value"))
    return read(spark, sf_dir, "events").where(guards.exceeds(logged, 20.0)).select("event_id")


@query
def running_totals(spark, sf_dir):
    return batching.flatten(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), [], "doc_id", "n_chars").select("doc_id", "ends", "starts")


# Text shapes dealt over the events, and arrays made from the documents.


def _shapes(spark: SparkSession, sf_dir: str, shapes: list[str | None]) -> DataFrame:
    texts = F.array(*[F.lit(s).cast("string") for s in shapes])
    return read(spark, sf_dir, "events").select("event_id", F.get(texts, (F.col("event_id") % len(shapes)).cast("int")).alias("text"))


def _tally(df: DataFrame, *columns) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.sequence(F.lit(1), (F.col("doc_id") % 9 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", ids.alias("input_ids"), F.transform(ids, lambda x: F.when(x % 3 == 0, 1).otherwise(0)).alias("mask"))


@query
def argument_names(spark, sf_dir):
    given = F.create_map(F.col("event_type"), F.lit("1"))
    faults = python_calls.argument_faults(given, F.create_map(F.lit("click"), F.lit("string"), F.lit("view"), F.lit("string")), F.array(F.lit("click")))
    shown = read(spark, sf_dir, "events").select(faults.alias("f"))
    return _tally(shown, F.array_join("f.unknown", ",").alias("unknown"), F.array_join("f.missing", ",").alias("missing"))


@query
def loss_labels(spark, sf_dir):
    labels = arrays.labels_of(F.col("input_ids"), F.col("mask"))
    return _arrays(spark, sf_dir).select(
        "doc_id", F.array_join(labels, ",").alias("labels"), arrays.supervised(labels).alias("supervised"), F.array_join(arrays.shifted_positions(labels), ",").alias("shifted")
    )


@query
def padded_batches(spark, sf_dir):
    wide = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))
    batches = _arrays(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 4)).withColumn("wide", wide)
    return batches.select("doc_id", F.array_join(arrays.pad(F.col("input_ids"), F.col("wide"), 0), ",").alias("padded"))


@query
def training_records(spark, sf_dir):
    made = trajectories.training_record(_arrays(spark, sf_dir), 2, "full")
    columns = ("input_ids", "labels", "schema_version", "semantics", "seq_length", "supervised_tokens")
    return made.select("doc_id", "seq_length", "supervised_tokens", arrays.record_fault({c: F.col(c) for c in columns}, 2, "full").alias("fault"))


@query
def span_masks(spark, sf_dir):
    n = (F.col("doc_id") % 4).cast("int")

    def span(start, end, kept):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kept).alias("supervised"))

    spans = F.array(span(F.lit(0), n + 1, False), span(n + F.when(n == 3, 2).otherwise(1), F.lit(6), True))
    return read(spark, sf_dir, "documents").select("doc_id", arrays.spans_are_gapless(spans).alias("gapless"), F.array_join(arrays.spans_to_mask(spans), "").alias("mask"))


@query
def eta_slope(spark, sf_dir):
    samples = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return telemetry.eta_slope(samples, ["user_id"], "event_id", "value").select("event_id", "s_per_step")


@query
def episode_summary(spark, sf_dir):
    episodes = read(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("terminal_reason"), F.col("l_linenumber").alias("steps"), F.col("l_suppkey").alias("tokens"),
        F.when(F.col("l_linestatus") == "O", F.col("l_discount")).alias("reward"), F.lit(1).alias("invalid_calls"),
    )
    row = telemetry.episode_summary(episodes, 1000.0)
    ends = F.array_join(F.transform(F.array_sort(F.map_entries("terminals")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return row.withColumn("terminals", ends)


@query
def rewards_checked(spark, sf_dir):
    return evaluation.reward_contract(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("reward")))


@query
def resume_cursor(spark, sf_dir):
    return batching.resume(pack_batches(spark, sf_dir), 2).select("lang", "batch", "tokens")
