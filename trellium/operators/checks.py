"""State snapshots and checks on them, stated as data; no code that data brings is ever run.

A check is a row: item, path, op and value. ``path`` is a JSON path into the state,
``value`` a JSON literal, ``op`` one of OPS. A check whose op is unknown, or whose path or
value the state cannot answer, fails with a reason and still counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("eq", "ne", "ge", "le", "exists", "contains")


def snapshot(state: Column) -> Column:
    """Canonical JSON of a state object: keys sorted, private ``__x__`` ones left out; null for anything else."""
    public = F.map_filter(F.from_json(state, "map<string,variant>"), lambda k, v: ~k.rlike("^__.*__$"))

    def pair(e: Column) -> Column:
        # {"k":"..."} without its first five characters and the last is the quoted key
        named = F.to_json(F.struct(e["key"].alias("k")))
        return F.concat(named.substr(F.lit(6), F.length(named) - 6), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null")))

    names = F.array_sort(F.map_keys(public))
    body = F.array_join(F.transform(names, lambda k: pair(F.struct(k.alias("key"), F.element_at(public, k).alias("value")))), ",")
    return F.when(public.isNotNull(), F.concat(F.lit("{"), body, F.lit("}")))


def same_state(a: Column, b: Column) -> Column:
    """Whether two states have equal snapshots; a state that is none equals nothing."""
    return F.coalesce(snapshot(a) == snapshot(b), F.lit(False))


def outcome(state: Column, path: Column, op: Column, value: Column) -> Column:
    """struct<passed, reason> of one check."""
    found = F.call_function("get_json_object", state, path)
    wanted = F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)
    a, b = found.try_cast("double"), wanted.try_cast("double")
    numeric = a.isNotNull() & b.isNotNull()
    passed = (
        F.when(op == "exists", found.isNotNull())
        .when(op == "eq", F.when(numeric, a == b).otherwise(found == wanted))
        .when(op == "ne", F.when(numeric, a != b).otherwise(found != wanted))
        .when(op == "ge", a >= b)
        .when(op == "le", a <= b)
        .when(op == "contains", found.contains(wanted))
    )
    reason = (
        F.when(~op.isin(*OPS), F.concat(F.lit("unknown op "), op))
        .when(found.isNull() & (op != "exists"), F.concat(F.lit("nothing at "), path))
        .when(passed.isNull(), F.lit("not comparable"))
    )
    return F.struct(F.coalesce(passed, F.lit(False)).alias("passed"), reason.alias("reason"))


def run_checks(states: DataFrame, checks: DataFrame, key: Sequence[str], state: str = "state") -> DataFrame:
    """The checks of each task (``key``, item, path, op, value) on its state, with passed and reason.

    A task without a state fails its checks. Both sides are joined on the key.
    """
    met = checks.join(states.select(*key, F.col(state).alias("_state")), list(key), "left")
    judged = met.withColumn("_o", outcome(F.col("_state"), F.col("path"), F.col("op"), F.col("value")))
    return judged.withColumns({"passed": F.col("_o.passed"), "reason": F.col("_o.reason")}).drop("_o", "_state")


def exact_fractions(checks: DataFrame, by: Sequence[str], expected: Column) -> DataFrame:
    """Passed over all checks of each group as an exact fraction; one that is not the expected share is an error.

    ``expected`` is a column of ``by`` or of literals: the number of checks that should pass.
    """
    counted = checks.groupBy(*by).agg(F.count_if(F.col("passed")).alias("passed"), F.count("*").alias("checks"))
    message = F.format_string("%d of %d checks passed", F.col("passed"), F.col("checks"))
    right = counted.withColumn("expected", expected).where(
        F.when(F.col("passed") == F.col("expected"), True).otherwise(F.raise_error(message).cast("boolean"))
    )
    return right.drop("expected").withColumn("reward", F.round(F.col("passed") / F.col("checks"), 4))
