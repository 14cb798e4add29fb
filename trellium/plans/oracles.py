"""DuckDB SQL for the queries of ``queries``, column names alike."""

from __future__ import annotations

from trellium.plans import recorded, shaped

_POINTS = """
points AS (SELECT l_linestatus AS precision, l_returnflag AS flag, l_linenumber AS config, count(*) AS n_runs,
  count(DISTINCT l_orderkey) AS n_reps, max(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) AS failed,
  round(median(l_extendedprice), 4) AS throughput, min(l_extendedprice) AS min_throughput, max(l_extendedprice) AS max_throughput,
  round(median(l_quantity), 4) AS latency FROM lineitem GROUP BY ALL)"""
_UPLIFT = f"""{_POINTS}, pairs AS (SELECT o.flag, o.config, round(100 * (f.throughput / o.throughput - 1), 2) AS uplift
  FROM points o JOIN points f USING (flag, config) WHERE o.precision = 'O' AND f.precision = 'F')"""
_TASKS = """
tasks AS (SELECT doc_id, lang AS category, coalesce(quality, 0)::DOUBLE AS score, coalesce(toxic, 0) AS invalid_calls, n_chars % 7 AS steps,
  n_chars AS generated_tokens, n_chars > 4000 AS truncated, quality AS exact, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"""
_METRICS = """count(*) AS n_tasks, round(avg(score), 6) AS score, round(sum(invalid_calls) / greatest(sum(steps), 1), 6) AS invalid_call_rate,
  round(avg(steps), 6) AS avg_steps, round(avg(generated_tokens), 6) AS avg_tokens, round(avg(truncated::INT), 6) AS truncation_rate,
  round(avg(exact), 6) AS exact_success_rate"""
_EVENTS = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS sec FROM events)"
_MASK = r"""
tok AS (SELECT conv_id, role, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM conversations),
counts AS (SELECT conv_id, sum(n)::BIGINT AS tokens, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS supervised,
  count(*) FILTER (role = 'user' AND NOT starts_with(regexp_replace(text, '^\s+', ''), '<tool_response>')) AS user_turns FROM tok GROUP BY conv_id)"""


def oracle_sql() -> dict[str, str]:
    found = _all() | shaped.SQL | recorded.SQL
    return found | {"resume_cursor": f"SELECT lang, batch, tokens FROM ({found['pack_batches']}) WHERE batch >= 2"}


def _all() -> dict[str, str]:
    return {
        "sweep_points": f"WITH {_POINTS} SELECT precision, flag, config, n_runs, throughput, min_throughput, max_throughput, latency FROM points",
        "sweep_validity": f"""WITH {_POINTS}, r AS (SELECT precision, flag, config, CASE WHEN n_reps <> n_runs THEN 'duplicate_repetition'
            WHEN failed > 0 THEN 'failed_requests' END AS reason FROM points) SELECT *, reason IS NULL AS valid FROM r""",
        "pareto_frontier": f"""WITH {_POINTS} SELECT precision, flag, config, throughput, latency FROM points a WHERE NOT EXISTS (SELECT 1 FROM points b
            WHERE b.precision = a.precision AND b.throughput >= a.throughput AND b.latency <= a.latency AND (b.throughput > a.throughput OR b.latency < a.latency))""",
        "matched_uplift": f"WITH {_UPLIFT} SELECT * FROM pairs",
        "uplift_summary": f"WITH {_UPLIFT} SELECT count(*) AS n, round(min(uplift), 2) AS low, round(median(uplift), 2) AS mid, round(max(uplift), 2) AS high FROM pairs",
        "select_profiles": f"""WITH {_POINTS}, p AS (SELECT *, latency AS ttft, round(min_throughput, 2) AS tpot FROM points),
            n AS (SELECT *, (throughput - min(throughput) OVER ()) / (max(throughput) OVER () - min(throughput) OVER ()) AS t,
              CASE WHEN max(ttft) OVER () = min(ttft) OVER () THEN 0 ELSE (ttft - min(ttft) OVER ()) / (max(ttft) OVER () - min(ttft) OVER ()) END AS l,
              CASE WHEN max(tpot) OVER () = min(tpot) OVER () THEN 0 ELSE (tpot - min(tpot) OVER ()) / (max(tpot) OVER () - min(tpot) OVER ()) END AS d FROM p)
            (SELECT 'latency' AS profile, precision, flag, config, throughput, latency FROM p ORDER BY ttft, tpot, throughput DESC, precision, flag, config LIMIT 1)
            UNION ALL (SELECT 'balanced', precision, flag, config, throughput, latency FROM n ORDER BY sqrt((1 - t) * (1 - t) + l * l + d * d), ttft, throughput DESC, precision, flag, config LIMIT 1)
            UNION ALL (SELECT 'throughput', precision, flag, config, throughput, latency FROM p ORDER BY throughput DESC, n_runs DESC, ttft, precision, flag, config LIMIT 1)""",
        "eligible_points": f"WITH {_POINTS} SELECT precision, flag, config, latency FROM points WHERE latency <= 25 AND config <= 4",
        "admission_limits": """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
            SELECT lang, 18 + greatest(1, round_even(18 * 0.25, 0))::BIGINT AS requests, (n_chars * greatest(1, round_even(18 * 0.25, 0)))::BIGINT AS queued_tokens
            FROM r WHERE i = ceil(0.95::DOUBLE * n)""",
        "category_metrics": f"WITH {_TASKS} SELECT category, {_METRICS} FROM tasks GROUP BY category",
        "overall_rollup": f"""WITH {_TASKS}, m AS (SELECT coalesce(category, 'overall') AS category, count(*) AS n_tasks, round(avg(score), 6) AS score,
            round(avg(generated_tokens), 6) AS avg_tokens FROM tasks GROUP BY GROUPING SETS ((category), ())) SELECT * FROM m""",
        "sparse_diagnostics": f"""WITH {_TASKS}, e AS (SELECT category, 'quality' AS key, quality AS v FROM tasks UNION ALL SELECT category, 'toxic', toxic FROM tasks)
            SELECT category, key, round(avg(v), 6) AS mean, count(*) AS denominator FROM e WHERE v IS NOT NULL GROUP BY category, key""",
        "terminal_rates": """WITH last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS reason FROM events GROUP BY user_id),
            c AS (SELECT (user_id % 3)::VARCHAR AS category, reason AS terminal_reason, count(*) AS n FROM last GROUP BY ALL)
            SELECT *, (sum(n) OVER (PARTITION BY category))::BIGINT AS denominator, round(n / sum(n) OVER (PARTITION BY category), 6) AS rate FROM c""",
        "group_variance": """WITH g AS (SELECT user_id, var_pop(value) AS v FROM events GROUP BY user_id)
            SELECT count(*) AS groups, round(avg(v), 4) AS mean_variance, round(avg((abs(v) <= 1e-12)::INT), 6) AS zero_fraction,
            round(1 - avg((abs(v) <= 1e-12)::INT), 6) AS useful_fraction FROM g""",
        "checklist_reward": """SELECT l_orderkey, count(*) AS checks, round(count(*) FILTER (l_returnflag <> 'R') / count(*), 4) AS reward,
            count(*) FILTER (l_linestatus = 'F') AS name_errors FROM lineitem GROUP BY l_orderkey""",
        "bag_containment": """WITH e AS (SELECT l_orderkey, l_returnflag, count(*) AS want FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL),
            a AS (SELECT l_orderkey, l_returnflag, count(*) AS have FROM lineitem WHERE l_linenumber >= 2 GROUP BY ALL)
            SELECT l_orderkey, bool_and(coalesce(have, 0) >= want) AS contained FROM e LEFT JOIN a USING (l_orderkey, l_returnflag) GROUP BY l_orderkey""",
        "running_mean": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS running_mean FROM events",
        "expected_set": """WITH f AS (SELECT DISTINCT s_nationkey AS k FROM supplier), x AS (SELECT DISTINCT n_regionkey AS k FROM nation)
            SELECT k, 'missing' AS problem FROM (SELECT k FROM x EXCEPT ALL SELECT k FROM f) UNION ALL SELECT k, 'unexpected' FROM (SELECT k FROM f EXCEPT ALL SELECT k FROM x)""",
        "comparison_table": f"""WITH {_TASKS} SELECT category, round(avg(score) FILTER (doc_id % 2 = 0), 6) AS even, round(avg(score) FILTER (doc_id % 2 = 1), 6) AS odd
            FROM tasks GROUP BY category""",
        "budget_share": f"WITH {_TASKS}, c AS (SELECT unnest([1, 2, 4, 6])::INT AS cap) SELECT cap, round(avg((steps <= cap)::INT), 4) AS share FROM tasks, c GROUP BY cap",
        "task_verdicts": """WITH t AS (SELECT conv_id, turn, max(length(text)) AS n FROM conversations GROUP BY ALL),
            g AS (SELECT conv_id AS task_id, bool_and(n > 20) AS done, count(*) AS have, min(turn) FILTER (n % 5 = 0 OR n % 3 = 0) AS f, arg_min(n % 5 = 0, turn) FILTER (n % 5 = 0 OR n % 3 = 0) AS s FROM t GROUP BY conv_id)
            SELECT task_id, CASE WHEN NOT done THEN 'never_completed' WHEN have <> 6 THEN 'snapshot_count_mismatch' WHEN s THEN 'state_mismatch_at_turn_' || f
            WHEN f IS NOT NULL THEN 'result_mismatch_at_turn_' || f ELSE 'pass' END AS verdict, done::INT::DOUBLE AS completion_rate, round(have / 6, 6) AS snapshot_count_ratio,
            CASE WHEN done AND have = 6 THEN (NOT coalesce(s, false))::INT::DOUBLE END AS state_match_rate,
            CASE WHEN done AND have = 6 AND NOT coalesce(s, false) THEN (f IS NULL)::INT::DOUBLE END AS result_match_rate FROM g""",
        "nearest_rank_p95": """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
            SELECT lang, n_chars AS p FROM r WHERE i = ceil(0.95::DOUBLE * n)""",
        "rounded_index_percentile": """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
            SELECT lang, n_chars AS p FROM r WHERE i = round_even(0.5::DOUBLE * (n - 1), 0)""",
        "episode_walls": f"""WITH {_EVENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS n FROM e WHERE event_type IN ('signup', 'purchase')),
            o AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN n END) OVER w AS last_open, max(CASE WHEN event_type = 'purchase' THEN n END) OVER w AS last_done
              FROM k WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
            SELECT d.event_id, d.user_id, round(greatest(d.sec - s.sec, 0), 3) AS wall_s FROM o d JOIN k s ON s.user_id = d.user_id AND s.n = d.last_open
            WHERE d.event_type = 'purchase' AND (d.last_done IS NULL OR d.last_open > d.last_done)""",
        "stage_union": f"""WITH {_EVENTS}, s AS (SELECT event_type, sec AS a, greatest(sec, sec + value * 60) AS z FROM e),
            c AS (SELECT *, max(z) OVER (PARTITION BY event_type ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
            SELECT event_type, round(sum(greatest(z - greatest(a, coalesce(m, a)), 0)), 1) AS busy, round(sum(z - a), 1) AS total, count(*) AS calls, round(max(z - a), 3) AS longest FROM c GROUP BY event_type""",
        "queue_depth": f"""WITH {_EVENTS}, s AS (SELECT event_type, floor(sec) AS a, floor(floor(sec) + value * 60) AS z FROM e),
            d AS (SELECT event_type, a AS t, 1 AS delta FROM s UNION ALL SELECT event_type, z, -1 FROM s),
            g AS (SELECT event_type, t, delta, sum(delta) AS change FROM d GROUP BY ALL),
            w AS (SELECT *, sum(change) OVER (PARTITION BY event_type ORDER BY t, delta ROWS UNBOUNDED PRECEDING) AS depth FROM g)
            SELECT event_type, max(depth)::BIGINT AS peak, count(*) AS changes, sum(change)::BIGINT AS net FROM w GROUP BY event_type""",
        "drift_tally": "SELECT sum(l_linenumber)::BIGINT AS clean, sum(length(l_returnflag))::BIGINT AS forked, max(l_quantity) AS drift_max FROM lineitem",
        "utilization": "SELECT round(avg(l_quantity), 6) AS mean, max(l_quantity) AS peak FROM lineitem",
        "sampled_table": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) <= 2 AS sampled FROM conversations)
            SELECT conv_id, turn, role, CASE WHEN sampled THEN text ELSE '' END AS text, sampled FROM r""",
        "long_metrics": f"""WITH {_TASKS}, m AS (SELECT category, round(avg(score), 6) AS s, round(avg(generated_tokens), 6) AS t FROM tasks GROUP BY category)
            SELECT category, 'eval/score' AS name, s AS value FROM m UNION ALL SELECT category, 'eval/avg_tokens', t FROM m""",
        "throughput_meter": """WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS tokens, count(DISTINCT o_custkey) AS seconds FROM orders GROUP BY 1)
            SELECT day::VARCHAR AS day, round(tokens / seconds, 4) AS tokens_per_s, round(seconds * 1e6 / tokens, 4) AS s_per_mtok, (sum(tokens) OVER (ORDER BY day))::BIGINT AS running_tokens FROM d""",
        "trim_conversations": """WITH l AS (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations)
            SELECT conv_id, count(*) FILTER (turn <= last) AS kept, count(*) FILTER (turn > last) AS removed FROM l GROUP BY conv_id HAVING count(*) FILTER (turn <= last) > 0""",
        "loss_mask": f"WITH {_MASK} SELECT * FROM counts",
        "conversion_accounting": f"""WITH {_MASK}, s AS (SELECT *, CASE WHEN user_turns = 0 THEN 'no user turn' WHEN supervised = 0 THEN 'nothing supervised' WHEN tokens > 600 THEN 'too_long' END AS reason FROM counts)
            SELECT CASE WHEN reason IS NULL THEN 'converted' ELSE 'skipped' END AS status, coalesce(reason, '') AS reason, count(*) AS n,
            sum(CASE WHEN reason IS NULL THEN supervised ELSE 0 END)::BIGINT AS supervised FROM s GROUP BY ALL""",
        "rendered_turns": r"""SELECT conv_id, sha256(string_agg('<|im_start|>' || CASE WHEN role = 'tool' THEN 'user' ELSE role END || chr(10) ||
            CASE WHEN role = 'tool' THEN '<tool_response>' || chr(10) || text || chr(10) || '</tool_response>' ELSE text END || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text)) AS rendered
            FROM conversations GROUP BY conv_id""",
        "prefix_drift": """WITH p AS (SELECT conv_id, turn, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b FROM conversations),
            c AS (SELECT conv_id, turn, b, (SELECT coalesce(min(i) - 1, least(length(a), length(b))) FROM range(1, least(length(a), length(b)) + 1) t(i) WHERE a[i] <> b[i])::INT AS common FROM p WHERE b IS NOT NULL)
            SELECT conv_id, turn, common, CASE WHEN length(b) = common THEN 'clean' WHEN common >= 1 AND length(b) - common < 1024 THEN 'realign' ELSE 'fork' END AS drift FROM c""",
        "pack_batches": """WITH RECURSIVE d AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
            p AS (SELECT lang, i, n_chars, 0::BIGINT AS batch, n_chars AS total FROM d WHERE i = 1 UNION ALL
              SELECT d.lang, d.i, d.n_chars, CASE WHEN p.total + d.n_chars > 40000 THEN batch + 1 ELSE batch END, CASE WHEN p.total + d.n_chars > 40000 THEN d.n_chars ELSE p.total + d.n_chars END
              FROM p JOIN d ON d.lang = p.lang AND d.i = p.i + 1)
            SELECT lang, batch, count(*) AS rows, max(n_chars) AS longest, sum(n_chars)::BIGINT AS tokens, (count(*) * max(n_chars) - sum(n_chars))::BIGINT AS padding FROM p GROUP BY lang, batch""",
        "rotate_sampler": """WITH t AS (SELECT count(*) AS n FROM part), p AS (SELECT p_partkey - 1 AS idx, (p_partkey - 1 - 37 + n) % n AS place, n FROM part, t)
            SELECT idx, (place // 8)::INT AS chunk, r::INT AS round, c::INT AS copy FROM p, range(2) a(r), range(3) b(c) WHERE place < n // 8 * 8""",
        "whole_groups": """WITH n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS position, count(*) OVER () AS t FROM supplier)
            SELECT s_suppkey, position, (position // 7)::BIGINT AS group_index FROM n WHERE position < t // 7 * 7""",
        "flatten_offsets": "SELECT conv_id, sum(length(text))::BIGINT AS cu_seqlen, max(length(text))::INT AS max_len FROM conversations GROUP BY conv_id",
        "tool_call_roundtrip": "SELECT event_id, event_type AS name, json_extract_string(props, '$.k') AS k FROM events",
        "redact_urls": r"SELECT page_id, regexp_replace(url, '^([a-z]+)://[^/?#]*([^?#]*).*$', '\1://redacted\2') AS endpoint FROM pages",
        "user_turns": "SELECT role, count(*) FILTER (role = 'user' AND NOT starts_with(ltrim(text), '<tool_response>')) AS user_turns, count(*) AS n FROM conversations GROUP BY role",
        "dedup_exact": "SELECT sha256(text) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
        "metric_rate": """WITH i AS (SELECT event_type, ts, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events),
            r AS (SELECT event_type, ts, round(100 * CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END)::BIGINT AS x FROM i)
            SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(sum(x) / 86400.0::DOUBLE, 9) AS rate FROM r GROUP BY 1, 2""",
        "gauge_window": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, max(value) AS peak, count(*) AS n FROM events GROUP BY 1, 2",
        "histogram_quantile": """WITH b AS (SELECT event_type, le, count(*) AS c FROM events, (SELECT unnest([1, 5, 10, 25, 50, 100, 250, 1000])::DOUBLE AS le) WHERE value <= le GROUP BY ALL),
            m AS (SELECT *, max(c) OVER (PARTITION BY event_type) * 0.95::DOUBLE AS want, coalesce(lag(c) OVER w, 0) AS prior, coalesce(lag(le) OVER w, 0) AS bound FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le))
            SELECT event_type, round(bound + (le - bound) * (want - prior) / (c - prior), 6) AS quantile FROM m WHERE c >= want AND prior < want""",
        "prometheus_sum": "SELECT 'events_' || event_type AS name, round(sum(floor(value)), 6) AS total FROM events GROUP BY event_type",
        "star_join": """SELECT r_name, o_orderpriority, count(*) AS n, max(o_totalprice) AS largest FROM orders JOIN customer ON o_custkey = c_custkey
            JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
        "missing_dimension": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)",
        "status_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS largest FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
        "session_windows": """WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR >= ts THEN 0 ELSE 1 END AS fresh FROM events),
            g AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l), c AS (SELECT user_id, s, count(*) AS n FROM g GROUP BY ALL)
            SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
        "held_out_tools": """WITH tools AS (SELECT DISTINCT conv_id, role AS name FROM conversations), turns AS (SELECT DISTINCT conv_id, turn FROM conversations),
            held AS (SELECT conv_id, role AS name, min(turn) AS hold_turn FROM conversations GROUP BY ALL)
            SELECT conv_id, turn, name FROM turns JOIN tools USING (conv_id) WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.conv_id = turns.conv_id AND h.name = tools.name AND h.hold_turn > turns.turn)""",
        "generation_ready": """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_linenumber >= 6 THEN 'turn_cap' WHEN l_quantity >= 45 THEN 'step_cap' WHEN l_partkey >= 180 - 8 THEN 'step_cap' END AS cap
              FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'O'),
            t AS (SELECT *, coalesce(sum(CASE WHEN cap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM r)
            SELECT l_suppkey, CASE WHEN taken >= 4 THEN 'wait' ELSE coalesce(cap, 'generate') END AS decision, count(*) AS n FROM t GROUP BY ALL""",
        "text_binding": """WITH s AS (SELECT text, min(doc_id) AS task_id FROM documents GROUP BY text), n AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)
            SELECT doc_id, task_id, position, position // 4 AS group_index FROM n JOIN s USING (text)""",
        "dimension_lookup": "SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey",
        "token_budgets": "SELECT doc_id, greatest(1, least(512, 4096 - n_chars - 8)) AS budget FROM documents",
        "eval_boundaries": "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR (o_orderkey > 0 AND o_orderkey % 50 = 0)",
        "mute_groups": """SELECT l_orderkey, count(*) AS episodes, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS reasons FROM lineitem
            GROUP BY l_orderkey HAVING max(CASE WHEN l_quantity > 20 THEN l_linenumber ELSE 0 END) = 0""",
        "cap_messages": "SELECT 'p' || p_partkey AS field, 'p' || p_partkey || '=' || p_size || ' exceeds cap 40' AS message FROM part WHERE p_size > 40",
        "turn_replay": """WITH r AS (SELECT event_id, user_id, ts, event_type <> 'purchase' AS has_call FROM events),
            t AS (SELECT *, coalesce(sum(CASE WHEN has_call THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS task_turn FROM r),
            s AS (SELECT *, row_number() OVER (PARTITION BY user_id, task_turn ORDER BY ts, event_id)::INT AS step FROM t),
            o AS (SELECT *, sum((step > 5)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gone FROM s)
            SELECT event_id, task_turn, step, CASE WHEN gone = 1 THEN 'step_cap' END AS terminal_reason FROM o WHERE gone <= 1""",
        "admission_window": """WITH RECURSIVE d AS (SELECT user_id, event_id, floor(value)::BIGINT AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
            a AS (SELECT user_id, event_id, i, 0::BIGINT AS starts, n AS ends, list_sort([0, 0, n]) AS free FROM d WHERE i = 1 UNION ALL
              SELECT d.user_id, d.event_id, d.i, a.free[1], a.free[1] + d.n, list_sort(list_append(a.free[2:], a.free[1] + d.n)) FROM a JOIN d ON d.user_id = a.user_id AND d.i = a.i + 1)
            SELECT event_id, starts, ends FROM a""",
        "call_outcomes": """WITH r AS (SELECT l_orderkey, min((l_shipdate, l_linenumber, l_returnflag)) AS f FROM lineitem GROUP BY l_orderkey),
            x AS (SELECT o_orderkey AS call_id, o_orderdate::DATE AS d, f[1]::DATE AS back, f[3] AS flag, DATE '1992-01-01' + floor((c_acctbal + 1000) / 5)::INT AS died FROM orders LEFT JOIN r ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
            y AS (SELECT *, died >= d AND (back IS NULL OR died <= back) AS lost FROM x)
            SELECT call_id, CASE WHEN lost THEN CASE WHEN died <= d + 40 THEN 'worker_crash' ELSE 'timeout' END WHEN back IS NULL OR back > d + 40 OR back < d THEN 'timeout' WHEN flag = 'R' THEN 'error' ELSE 'ok' END AS outcome FROM y""",
        "system_prompts": """SELECT r_name, 'Act.' || chr(10) || '# Environment Information' || chr(10) || chr(10) || '## Brief Introduction:  ' || chr(10) || r_name || chr(10) || chr(10)
            || '## Environment Rules / Constraints:  ' || chr(10) || string_agg('- ' || n_name || chr(10), '' ORDER BY n_name) AS prompt FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name""",
        "results_covered": """WITH e AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS want FROM lineitem WHERE l_quantity > 10 GROUP BY ALL)
            SELECT l_orderkey, l_linenumber, bool_and(want <= (SELECT count(*) FROM lineitem a WHERE a.l_orderkey = e.l_orderkey AND a.l_returnflag = e.l_returnflag AND a.l_linenumber <= e.l_linenumber AND a.l_quantity < 40)) AS covered
            FROM e GROUP BY ALL""",
        "eval_records": """SELECT doc_id AS task_id, lang, round(e.w, 4) AS wall_s, CASE WHEN e.w IS NULL THEN 'never_run' ELSE 'final_answer' END AS terminal_reason, coalesce(quality, 0)::DOUBLE AS score
            FROM documents LEFT JOIN (SELECT vec_id, vec_id / 7.0::DOUBLE AS w FROM embeddings) e ON doc_id = vec_id LEFT JOIN labels USING (doc_id)""",
        "study_points": "SELECT s_suppkey, p AS precision, s AS seqs, t AS tokens FROM supplier, (VALUES ('bf16'), ('fp8')) a(p), (VALUES (32, 4096), (64, 8192), (128, 16384)) b(s, t)",
        "ladder_lookup": f"WITH {_POINTS} SELECT l_orderkey AS run, config, throughput, latency FROM lineitem JOIN points ON precision = l_linestatus AND flag = l_returnflag AND config = l_linenumber",
        "strict_rows": "SELECT event_id FROM events WHERE regexp_matches(props, '[0-9]*[13579]\\b') AND event_type NOT LIKE '%c%'",
        "scenario_checks": "SELECT l_orderkey::VARCHAR AS task_id, count(*)::INT AS checks FROM lineitem GROUP BY l_orderkey",
        "logp_stops": "SELECT event_id FROM events WHERE event_id % 10 <> 0 AND value > 20",
        "running_totals": "SELECT doc_id, (sum(n_chars) OVER (ORDER BY doc_id))::BIGINT AS ends, (sum(n_chars) OVER (ORDER BY doc_id) - n_chars)::BIGINT AS starts FROM documents",
        "argument_names": """SELECT CASE WHEN event_type IN ('click', 'view') THEN '' ELSE event_type END AS unknown, CASE WHEN event_type = 'click' THEN '' ELSE 'click' END AS missing, count(*) AS n FROM events GROUP BY ALL""",
        "loss_labels": """WITH d AS (SELECT doc_id, list_transform(range(1, doc_id % 9 + 2), lambda x: CASE WHEN x % 3 = 0 THEN x ELSE -100 END) AS l FROM documents)
            SELECT doc_id, array_to_string(l, ',') AS labels, len(list_filter(l, lambda x: x <> -100))::INT AS supervised,
            array_to_string(list_filter(range(0, len(l) - 1), lambda i: l[i + 2] <> -100), ',') AS shifted FROM d""",
        "padded_batches": """WITH d AS (SELECT doc_id, doc_id % 9 + 1 AS n, max(doc_id % 9 + 1) OVER (PARTITION BY doc_id // 4) AS w FROM documents)
            SELECT doc_id, array_to_string(list_transform(range(1, w + 1), lambda x: CASE WHEN x <= n THEN x ELSE 0 END), ',') AS padded FROM d""",
        "training_records": """SELECT doc_id, (doc_id % 9 + 1)::INT AS seq_length, ((doc_id % 9 + 1) // 3)::INT AS supervised_tokens, CASE WHEN doc_id % 9 + 1 < 3 THEN 'unsupervised' END AS fault FROM documents""",
        "span_masks": """SELECT doc_id, doc_id % 4 <> 3 AS gapless, repeat('0', (doc_id % 4 + 1)::INT) || repeat('1', (6 - doc_id % 4 - CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 1 END)::INT) AS mask FROM documents""",
        "eta_slope": """WITH w AS (SELECT event_id, value, first_value(value) OVER f AS v, first_value(event_id) OVER f AS e FROM events WINDOW f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
            SELECT event_id, CASE WHEN event_id > e THEN round((value - v) / (event_id - e), 6) END AS s_per_step FROM w""",
        "episode_summary": """SELECT count(*) AS episodes, round(count(*) * 3600 / 1000.0::DOUBLE, 4) AS episodes_per_hour, round(sum(l_suppkey) / 1000.0::DOUBLE, 4) AS tokens_per_s,
            round(avg(CASE WHEN l_linestatus = 'O' THEN l_discount END), 6) AS mean_reward, round(avg(l_linenumber), 6) AS mean_steps, count(*) AS invalid_calls,
            (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT CASE WHEN l_returnflag <> 'R' THEN l_returnflag ELSE 'none' END AS k, count(*) AS n FROM lineitem GROUP BY 1)) AS terminals FROM lineitem""",
        "rewards_checked": "SELECT l_orderkey, l_linenumber, l_discount AS reward FROM lineitem",
    }
