"""Checks stated as conditions on a final and an initial state, as columns; nothing is executed.

A condition is an expression in Python's syntax, bare or as what a function
``check_func(final_state)`` returns. Python's own parser reads it once on the driver, and
each node becomes a column: names of the states, constants, subscripts and ``get``, ``and``,
``or``, ``not``, comparisons, ``in``, arithmetic, ``len``, ``abs`` and ``any``, ``all``,
``sum`` and ``len`` over a comprehension with conditions. Anything else makes the check
unrunnable, which counts as failed.

A null column stands for what raises: a key that is missing, types that do not compare. It
ends the check as failed, unless ``and`` or ``or`` is decided before it, as in Python.

A state is parsed once per row, whatever the number of conditions. Fixed keys are one path
into it, and a value whose kind the source fixes (a comparison, a sum, a constant) is a plain
column: only what a state holds is a variant whose kind is looked up by row.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellium.functions.arrays import bound

FUNCTION = "check_func"
ORDERS = {ast.Lt: lambda x, y: x < y, ast.LtE: lambda x, y: x <= y, ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y}
NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")
#: The type in which a value of a kind is held and compared.
HELD = {"number": "double", "STRING": "string", "BOOLEAN": "boolean"}
OBJECT, ARRAY = "map<string,variant>", "array<variant>"


class UnrunnableError(ValueError):
    """Why a condition is none: ``kind`` is the type of error it counts as."""

    def __init__(self, kind: str, why: str):
        super().__init__(why)
        self.kind = kind


def type_of(value: Column) -> Column:
    """The type of a variant without its parameters: one of NUMBERS, STRING, BOOLEAN, ARRAY, OBJECT or VOID."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def _is(type_: Column, kind: str) -> Column:
    return type_.isin(*NUMBERS) if kind == "number" else type_ == kind


@dataclass(frozen=True)
class _Value:
    """What a node of a condition becomes; null if it raises.

    With a ``kind`` that the source fixes (number, STRING, BOOLEAN, VOID or ARRAY) the column is a
    plain one of that kind; without, it is the variant at ``path`` in the column.
    ``simple`` values cost little and may be repeated, others are bound first. A state
    ``is_object`` where its check is judged at all.
    """

    column: Column
    kind: str | None = None
    path: str = "$"
    simple: bool = False
    is_object: bool = False

    def bind(self, body: Callable[[_Value], Column]) -> Column:
        """``body`` of the value, which is computed once however often the body uses it."""
        return body(self) if self.simple else bound(self.column, lambda x: body(replace(self, column=x, simple=True)))

    def variant(self) -> Column:
        if self.kind is None:
            return self.column if self.path == "$" else F.try_variant_get(self.column, self.path, "variant")
        return F.parse_json(F.lit("null")) if self.kind == "VOID" else self.column.cast("variant")

    def got(self, cast: str) -> Column:
        return F.try_variant_get(self.column, self.path, cast)

    def type(self) -> Column:
        return type_of(self.variant())

    def defined(self) -> Column:
        return self.column.isNotNull() if self.kind else self.variant().isNotNull()

    def may_be(self, kind: str) -> bool:
        return self.kind in (None, kind)

    def of_kind(self, kind: str) -> Column:
        """The value as a number, text or flag; null if it is of another kind."""
        if self.kind is None and kind == "number":
            # whole numbers are read as what they are: a variant's own conversion makes a new cast by value
            return self.bind(lambda v: F.when(v.type() == "BIGINT", v.got("bigint").cast("double")).when(_is(v.type(), kind), v.got("double")))
        if self.kind is None:
            return self.bind(lambda v: F.when(v.type() == kind, v.got(HELD[kind])))
        return (self.column if self.kind == kind else F.lit(None)).cast(HELD[kind])

    def array(self) -> Column:
        return self.got(ARRAY) if self.kind is None else self.column if self.kind == "ARRAY" else F.lit(None).cast(ARRAY)

    def object(self) -> Column:
        return self.got(OBJECT) if self.kind is None else F.lit(None).cast(OBJECT)

    def elements(self) -> Column:
        """What iteration yields: the elements of an array, the keys of an object."""
        if self.kind is not None:
            return self.array()
        return self.bind(lambda v: F.coalesce(v.array(), F.transform(F.map_keys(v.object()), lambda k: k.cast("variant"))))

    def size(self) -> Column:
        if self.kind is not None:
            return F.length(self.column) if self.kind == "STRING" else F.array_size(self.array())
        return self.bind(lambda v: F.coalesce(F.array_size(v.array()), F.array_size(F.map_keys(v.object())), F.length(v.of_kind("STRING"))))

    def truth(self) -> Column:
        """Whether Python takes a value as true."""
        if self.kind is not None:
            return {"BOOLEAN": lambda: self.column, "number": lambda: self.column != 0, "VOID": lambda: F.lit(False)}.get(self.kind, lambda: self.size() > 0)()

        def of(v: _Value, type_: Column) -> Column:
            return (
                F.when(type_ == "BOOLEAN", v.got("boolean")).when(type_ == "BIGINT", v.got("bigint") != 0).when(_is(type_, "number"), v.got("double") != 0).when(type_ == "VOID", False).otherwise(v.size() > 0)
            )

        return self.bind(lambda v: bound(v.type(), lambda t: of(v, t)))


def _flag(column: Column) -> _Value:
    return _Value(column, "BOOLEAN")


def _number(column: Column) -> _Value:
    return _Value(column, "number")


def _chosen(flag: Column, then: Column, otherwise: Column) -> Column:
    """One or the other, null if the flag is; each is named once."""
    return F.get(F.array(otherwise, then), flag.cast("int"))


def _equal(a: _Value, b: _Value) -> Column:
    """Equality of JSON values; numbers by value, containers by their text, whose keys a variant keeps sorted."""
    if a.kind in HELD and a.kind == b.kind:
        return a.column == b.column
    if a.kind is None and b.kind is None or "ARRAY" in (a.kind, b.kind):
        same = lambda a, b: (F.to_json(a.variant()) == F.to_json(b.variant())) | F.coalesce(a.of_kind("number") == b.of_kind("number"), F.lit(False))
        return a.bind(lambda a: b.bind(lambda b: F.when(a.defined() & b.defined(), same(a, b))))
    if a.kind is None:
        a, b = b, a
    if b.kind is not None:
        return F.when(a.defined() & b.defined(), a.kind == b.kind)
    if a.kind == "VOID":
        return b.bind(lambda b: F.when(b.defined(), F.is_variant_null(b.variant())))
    same = lambda a, b: F.coalesce(a.of_kind(a.kind) == b.of_kind(a.kind), F.lit(False))
    return a.bind(lambda a: b.bind(lambda b: F.when(a.defined() & b.defined(), same(a, b))))


def _identical(a: _Value, b: _Value) -> Column:
    if {a.kind, b.kind} & {"VOID", "BOOLEAN", "STRING"}:
        return _equal(a, b)

    def same(a: _Value, b: _Value) -> Column:
        kinds = [F.when(_is(v.type(), "number"), "number").otherwise(v.type()) if v.kind is None else F.lit(v.kind) for v in (a, b)]
        return F.when(a.defined() & b.defined(), (F.to_json(a.variant()) == F.to_json(b.variant())) & (kinds[0] == kinds[1]))

    return a.bind(lambda a: b.bind(lambda b: same(a, b)))


def _ordered(order: Callable[[Column, Column], Column], a: _Value, b: _Value) -> Column:
    def of(a: _Value, b: _Value) -> Column:
        by = [order(a.of_kind(k), b.of_kind(k)) for k in ("number", "STRING") if a.may_be(k) and b.may_be(k)]
        return F.coalesce(*by) if by else F.lit(None).cast("boolean")

    return a.bind(lambda a: b.bind(lambda b: of(a, b)))


def _contains(item: _Value, whole: _Value) -> Column:
    def of(item: _Value, whole: _Value) -> Column:
        within = F.exists(whole.elements(), lambda e: F.coalesce(_equal(_Value(e, simple=True), item), F.lit(False)))
        return F.when(item.defined(), F.coalesce(within, whole.of_kind("STRING").contains(item.of_kind("STRING"))))

    return item.bind(lambda item: whole.bind(lambda whole: of(item, whole)))


def _listed(item: _Value, values: Sequence[_Value]) -> Column:
    """Whether the item equals one of the simple values of a list that is written out."""

    def of(item: _Value) -> Column:
        known, found = F.lit(True), F.lit(False)
        for v in values:
            known, found = known if v.kind else known & v.defined(), found | _equal(v, item)
        return F.when(known, found)

    return item.bind(of)


class _Compiler:
    """Values of the nodes of an expression; states are known to be objects."""

    def __init__(self, names: Mapping[str, _Value]):
        self.names = dict(names)

    def of(self, node: ast.AST) -> _Value:
        method = getattr(self, f"_{type(node).__name__}", None)
        if method is None:
            raise UnrunnableError("SyntaxError", f"{type(node).__name__} is no part of a condition")
        return method(node)

    def _Constant(self, node: ast.Constant) -> _Value:
        if node.value is None:
            return _Value(F.lit(True), "VOID", simple=True)
        for type_, kind in ((bool, "BOOLEAN"), (int | float, "number"), (str, "STRING")):
            if isinstance(node.value, type_):
                return _Value(F.lit(node.value), kind, simple=True)
        raise UnrunnableError("SyntaxError", f"constant {node.value!r}")

    def _List(self, node: ast.List) -> _Value:
        if not node.elts:
            return _Value(F.parse_json(F.lit("[]")), simple=True)
        held = F.array(*[self.of(x).variant() for x in node.elts])
        return _Value(bound(held, lambda x: F.when(F.forall(x, lambda e: e.isNotNull()), x)), "ARRAY")

    _Tuple = _List

    def _Name(self, node: ast.Name) -> _Value:
        if node.id not in self.names:
            raise UnrunnableError("NameError", f"name {node.id!r} is not defined")
        return self.names[node.id]

    def _Subscript(self, node: ast.Subscript) -> _Value:
        return self._item(self.of(node.value), node.slice)

    def _item(self, whole: _Value, node: ast.AST) -> _Value:
        fixed, key = node.value if isinstance(node, ast.Constant) else None, self.of(node)
        if whole.kind is None and whole.simple:
            # what a path can say; other keys are looked up in the map
            if isinstance(fixed, str) and re.fullmatch(r"\w[^'?]*", fixed):
                return replace(whole, path=f"{whole.path}['{fixed}']", is_object=False)
            if type(fixed) is int and 0 <= fixed < 2**31 - 1:
                return replace(whole, path=f"{whole.path}[{fixed}]", is_object=False)
        at = lambda place: F.when(place == F.floor(place), F.when(place >= 0, place + 1).otherwise(place)).try_cast("int")

        def of(whole: _Value, key: _Value) -> Column:
            found = [F.try_element_at(whole.object(), key.of_kind("STRING"))] if key.may_be("STRING") and whole.kind is None else []
            found += [F.try_element_at(whole.array(), bound(key.of_kind("number"), at))] if key.may_be("number") else []
            return F.coalesce(*found) if found else F.lit(None).cast("variant")

        return _Value(whole.bind(lambda w: key.bind(lambda k: of(w, k))))

    def _BoolOp(self, node: ast.BoolOp) -> _Value:
        out = self.of(node.values[-1])
        for value in reversed(node.values[:-1]):
            out = self._either(self.of(value), out, isinstance(node.op, ast.Or))
        return out

    @staticmethod
    def _either(first: _Value, other: _Value, stop: bool) -> _Value:
        """The first value if it decides, else the other; null if the first is."""
        if first.kind == other.kind == "BOOLEAN":
            return _flag(_chosen(first.column, F.lit(True), other.column) if stop else _chosen(first.column, other.column, F.lit(False)))
        decided = lambda v: bound(v.truth(), lambda t: F.when(t == F.lit(stop), v.variant()).when(t.isNotNull(), other.variant()))
        return _Value(first.bind(decided))

    def _UnaryOp(self, node: ast.UnaryOp) -> _Value:
        value = self.of(node.operand)
        if isinstance(node.op, ast.Not):
            return _flag(~value.truth())
        if isinstance(node.op, ast.USub):
            return _number(-value.of_kind("number"))
        raise UnrunnableError("SyntaxError", type(node.op).__name__)

    def _BinOp(self, node: ast.BinOp) -> _Value:
        rest = lambda a, b: bound(F.struct(a.alias("a"), b.alias("b")), lambda x: F.when(x["b"] != 0, x["a"] - x["b"] * F.floor(x["a"] / x["b"])))
        made = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Mod: rest}.get(type(node.op))
        if made is None:
            raise UnrunnableError("SyntaxError", type(node.op).__name__)
        return _number(made(self.of(node.left).of_kind("number"), self.of(node.right).of_kind("number")))

    def _Compare(self, node: ast.Compare) -> _Value:
        sides = [node.left, *node.comparators]
        out = None
        for op, a, b in reversed(list(zip(node.ops, sides, sides[1:], strict=False))):
            one = _flag(self._test(op, a, b))
            out = one if out is None else self._either(one, out, False)
        return out

    def _test(self, op: ast.cmpop, left: ast.AST, right: ast.AST) -> Column:
        a = self.of(left)
        if isinstance(op, ast.In | ast.NotIn):
            values = [self.of(x) for x in right.elts] if isinstance(right, ast.List | ast.Tuple) else []
            within = _listed(a, values) if values and all(v.simple for v in values) else _contains(a, self.of(right))
            return within if isinstance(op, ast.In) else ~within
        b = self.of(right)
        if type(op) in ORDERS:
            return _ordered(ORDERS[type(op)], a, b)
        same = _equal(a, b) if isinstance(op, ast.Eq | ast.NotEq) else _identical(a, b)
        return same if isinstance(op, ast.Eq | ast.Is) else ~same

    def _Call(self, node: ast.Call) -> _Value:
        if node.keywords:
            raise UnrunnableError("SyntaxError", "keyword arguments")
        if isinstance(node.func, ast.Attribute):
            return self._method(node)
        name = node.func.id if isinstance(node.func, ast.Name) else ""
        if len(node.args) == 1 and isinstance(node.args[0], ast.GeneratorExp | ast.ListComp) and name in ("any", "all", "sum", "len"):
            return self._over(name, node.args[0])
        if name == "len" and len(node.args) == 1:
            return _number(self.of(node.args[0]).size())
        if name == "abs" and len(node.args) == 1:
            return _number(F.abs(self.of(node.args[0]).of_kind("number")))
        raise UnrunnableError("NameError", f"{name or 'what is called'} is not defined")

    def _method(self, node: ast.Call) -> _Value:
        whole, name, given = self.of(node.func.value), node.func.attr, [self.of(x) for x in node.args]
        if name == "get" and len(given) in (1, 2):
            other = given[1] if len(given) == 2 else _Value(F.lit(True), "VOID", simple=True)
            found = lambda w: F.when(F.lit(True) if w.is_object else w.object().isNotNull(), F.coalesce(self._item(w, node.args[0]).variant(), other.variant()))
            return _Value(whole.bind(found))
        if name in ("values", "keys") and not given:
            return _Value(F.map_values(whole.object()) if name == "values" else F.transform(F.map_keys(whole.object()), lambda k: k.cast("variant")), "ARRAY")
        if name in ("startswith", "endswith") and len(given) == 1:
            return _flag((F.startswith if name == "startswith" else F.endswith)(whole.of_kind("STRING"), given[0].of_kind("STRING")))
        if name in ("lower", "upper") and not given:
            return _Value((F.lower if name == "lower" else F.upper)(whole.of_kind("STRING")), "STRING")
        raise UnrunnableError("AttributeError", f"no method {name}")

    def _over(self, name: str, made: ast.GeneratorExp | ast.ListComp) -> _Value:
        if len(made.generators) != 1 or not isinstance(made.generators[0].target, ast.Name):
            raise UnrunnableError("SyntaxError", "a comprehension of one name")
        loop = made.generators[0]
        each = lambda e, node: _Compiler({**self.names, loop.target.id: _Value(e, simple=True)}).of(node)
        values, ifs = self.of(loop.iter).elements(), loop.ifs
        test = ifs[0] if len(ifs) == 1 else ast.BoolOp(ast.And(), ifs)
        kept = lambda e, so_far, then: _chosen(each(e, test).truth(), then, so_far) if ifs else then
        if name == "len":
            return _number(F.aggregate(values, F.lit(0), lambda n, e: kept(e, n, n + 1)))
        if name == "sum":
            return _number(F.aggregate(values, F.lit(0.0), lambda total, e: kept(e, total, total + self._summand(each(e, made.elt)))))
        going = F.lit(name == "all")

        def step(so_far: Column, e: Column) -> Column:
            one = each(e, made.elt).truth()
            if isinstance(made, ast.ListComp):
                # a list is made whole, so whatever raises in it counts
                return F.when(so_far.isNotNull(), kept(e, so_far, _chosen(one, *((so_far, F.lit(False)) if name == "all" else (F.lit(True), so_far)))))
            return F.when(so_far == going, kept(e, so_far, one)).otherwise(so_far)

        return _flag(F.aggregate(values, going, step))

    @staticmethod
    def _summand(value: _Value) -> Column:
        if value.kind is not None:
            return (value.column if value.kind in ("number", "BOOLEAN") else F.lit(None)).cast("double")
        return value.bind(lambda v: F.coalesce(v.of_kind("number"), v.of_kind("BOOLEAN").cast("double")))


def expression(source: str) -> ast.AST:
    """The expression that a source states: itself, or what its ``check_func`` returns."""
    try:
        return ast.parse(source.strip(), mode="eval").body
    except SyntaxError:
        pass
    try:
        body = ast.parse(source).body
    except (SyntaxError, ValueError) as error:
        raise UnrunnableError("SyntaxError", str(error)) from None
    function = next((x for x in body if isinstance(x, ast.FunctionDef) and x.name == FUNCTION), None)
    said = [x for x in function.body if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant))] if function else []
    if len(said) != 1 or not isinstance(said[0], ast.Return) or said[0].value is None:
        raise UnrunnableError("SyntaxError", f"no {FUNCTION} of one return")
    return said[0].value


def _outcome(value: _Value, objects: Column) -> dict[str, Column]:
    """passed, error_type and reason of a condition's value."""
    flag, raised = value.of_kind("BOOLEAN"), ~value.defined()
    error = F.when(~objects, "TypeError").when(raised, "LookupError")
    reason = F.when(~objects, "a state is no object").when(raised, "a key is missing, or types do not compare")
    if value.kind != "BOOLEAN":
        kind = F.lit(value.kind.lower()) if value.kind else F.when(_is(value.type(), "number"), "number").otherwise(F.lower(value.type()))
        error = error.when(flag.isNull(), "NonBoolResult")
        reason = reason.when(flag.isNull(), F.concat(F.lit("the condition is "), kind, F.lit(", not boolean")))
    return {"passed": F.coalesce(objects & flag, F.lit(False)), "error_type": error, "reason": reason}


def run(states: DataFrame, conditions: Mapping[str, str], final: str = "final_state", initial: str | None = "initial_state") -> DataFrame:
    """``states``, whose states are JSON texts, with a row for each condition (item to source): item, passed, error_type, reason.

    Without an initial state its name is unknown. A state that is no object fails every check that is runnable.
    """
    texts = {"final_state": final} | ({} if initial is None else {"initial_state": initial})
    parsed = states.withColumn("_c", F.struct(*[F.try_parse_json(F.col(text)).alias(n) for n, text in texts.items()]))
    objects = F.lit(True)
    for n in texts:
        objects = objects & F.try_variant_get(F.col(f"_c.{n}"), "$", OBJECT).isNotNull()
    compiler = _Compiler({n: _Value(F.col(f"_c.{n}"), simple=True, is_object=True) for n in texts})

    values, each = [], []
    for at, (item, source) in enumerate(conditions.items()):
        try:
            value = compiler.of(expression(source))
            values.append((value.variant() if value.kind is None else value.column).alias(f"v{at}"))
            found = _outcome(_Value(F.col(f"_c.v{at}"), value.kind, simple=True), F.col("_c.ok"))
        except UnrunnableError as error:
            found = {"passed": F.lit(False), "error_type": F.lit(error.kind), "reason": F.lit(str(error))}
        each.append(F.struct(F.lit(item).alias("item"), *[column.alias(n) for n, column in found.items()]))

    # a value is a column of its own before its outcome uses it more than once
    judged = parsed.withColumn("_c", F.struct(objects.alias("ok"), *values))
    exploded = judged.withColumn("_c", F.explode(F.array(*each)))
    return exploded.withColumns({n: F.col(f"_c.{n}") for n in ("item", "passed", "error_type", "reason")}).drop("_c")


def scores(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: checks, how many passed, the share as reward, and how many failed by an unknown name."""
    return results.groupBy(*by).agg(
        F.count("*").alias("checks"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("reward"),
        F.count_if(F.col("error_type") == "NameError").alias("name_errors"),
    )
