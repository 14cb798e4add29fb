"""Calls written as Python text, and argument values by declared type. Nothing is executed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_python_calls(text: Column) -> Column:
    """struct<name, args: array, kwargs: map> of a call of literals, values as JSON; null for anything else."""
    import pandas as pd

    def one(source: str | None) -> dict | None:
        import ast
        import json

        try:
            call = ast.parse(source, mode="eval").body
            if not isinstance(call, ast.Call) or any(isinstance(a, ast.Starred) for a in call.args) or any(k.arg is None for k in call.keywords):
                return None
            value = lambda node: json.dumps(ast.literal_eval(node), ensure_ascii=False)
            return {"name": ast.unparse(call.func), "args": [value(a) for a in call.args], "kwargs": {k.arg: value(k.value) for k in call.keywords}}
        except (SyntaxError, ValueError, TypeError):
            return None

    def run(column: pd.Series) -> pd.DataFrame:
        found = [one(x) or {"name": None, "args": None, "kwargs": None} for x in column]
        return pd.DataFrame(found, columns=["name", "args", "kwargs"])

    run.__annotations__ = {"column": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "name string, args array<string>, kwargs map<string,string>")(text)


def call_text(name: Column, arguments: Column) -> Column:
    """``name(k=repr, ...)`` of a call whose ``arguments`` are a JSON object as text, in its order; null for anything else."""
    import pandas as pd

    def run(names: pd.Series, texts: pd.Series) -> pd.Series:
        import json

        def one(n: str | None, t: str | None) -> str | None:
            try:
                given = json.loads(t) if n is not None and t is not None else None
            except ValueError:
                return None
            return f"{n}({', '.join(f'{k}={v!r}' for k, v in given.items())})" if isinstance(given, dict) else None

        return pd.Series([one(n, t) for n, t in zip(names, texts, strict=True)], dtype=object)

    run.__annotations__ = {"names": pd.Series, "texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(name, arguments)


#: What Python's int and float read, but for surrounding space.
WHOLE = r"^[+-]?[0-9](_?[0-9])*$"
REAL = r"(?i)^[+-]?(([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)(e[+-]?[0-9](_?[0-9])*)?|inf|infinity|nan)$"


def coerced(value: Column, declared: Column) -> Column:
    """struct<value, reason>: a variant as the text of a value of the declared type, or why it is none.

    Text that reads as a boolean or number becomes one, as Python's int and float read it;
    numbers and booleans become text as Python writes them; containers are checked by
    their outer shape. Unknown and null types take anything.
    """
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    said = F.try_variant_get(value, "$", "string")
    bare = F.regexp_replace(said, r"^\s+|\s+$", "")
    plain = F.replace(bare, F.lit("_"), F.lit(""))
    is_text, is_flag = kind == "STRING", kind == "BOOLEAN"
    is_whole = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | F.schema_of_variant(value).rlike(r"^DECIMAL\([0-9]+,0\)$")
    is_real = kind.isin("DECIMAL", "DOUBLE", "FLOAT") & ~is_whole
    number = F.try_variant_get(value, "$", "double")
    digits = F.regexp_replace(F.regexp_replace(plain, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    integer = (
        F.when(is_whole, said).when(is_real & (number == F.floor(number)), number.try_cast("decimal(38,0)").cast("string"))
        .when(is_text & bare.rlike(WHOLE), F.when(digits == "-0", "0").otherwise(digits))
    )
    fits = F.when(declared == "boolean", F.when(is_flag, said).when(is_text & F.lower(bare).isin("true", "false"), F.lower(bare)))
    fits = fits.when(declared == "integer", integer).when(declared == "number", F.when(is_whole | is_real, said).when(is_text & bare.rlike(REAL), plain))
    fits = fits.when(declared == "string", F.when(is_text, said).when(is_flag, F.initcap(said)).when(is_whole | is_real, said))
    for name, want in (("array", "ARRAY"), ("object", "OBJECT")):
        fits = fits.when(declared == name, F.when(kind == want, F.to_json(value)))
    out = fits.otherwise(F.when(is_text, said).otherwise(F.to_json(value)))
    return F.struct(out.alias("value"), F.when(value.isNotNull() & out.isNull(), F.concat(F.lit("not "), declared)).alias("reason"))


def coerce_argument(value: Column, declared: Column) -> Column:
    """``coerced`` of a JSON value as text; text that is no JSON counts as a string. Numbers stay as they are written."""
    written = F.when((declared == "number") & value.rlike(REAL), F.struct(value.alias("value"), F.lit(None).cast("string").alias("reason")))
    return F.coalesce(written, coerced(F.coalesce(F.try_parse_json(value), value.cast("variant")), declared))


def argument_faults(given: Column, declared: Column, required: Column) -> Column:
    """Unknown and missing parameter names of a call, sorted."""
    names = F.map_keys(given)
    return F.struct(
        F.array_sort(F.array_except(names, F.map_keys(declared))).alias("unknown"), F.array_sort(F.array_except(required, names)).alias("missing")
    )
