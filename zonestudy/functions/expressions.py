"""The filter language: boolean expressions over an event's features, compiled to columns."""

from __future__ import annotations

import ast
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names that an expression can use.
FEATURES = (
    "hour", "minute", "dow", "month", "year", "session", "atr", "zone_height", "zone_height_atr", "bars_since_zone", "test_number",
    "displacement_atr", "bias", "dist_ema50_atr", "day_range_atr", "prior_day_range_atr", "gap_atr", "htf_bias", "htf_bar_dir", "htf_slope_atr",
    "htf_dist_ema_atr", "htf_range_atr", "htf_bar_progress", "aligned", "aligned_bar",
)
TEXT = ("session",)
LARGEST_EXPONENT = 64


class ExpressionError(ValueError):
    """An expression that can't be run on any row."""


@dataclass(frozen=True)
class Value:
    """A column that is null where the row can't be evaluated, and its kind: number, flag, text, or a list of values."""

    column: Column | None
    kind: str
    items: tuple[Value, ...] = ()
    constant: object = None


def _all_there(values: Iterable[Value]) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v.column.isNotNull()
    return out


def _number(v: Value) -> Column:
    if v.kind == "flag":
        return v.column.cast("double")
    if v.kind != "number":
        raise ExpressionError("a number is needed here")
    return v.column


def _truth(v: Value) -> Column:
    if v.kind == "flag":
        return v.column
    if v.kind == "number":
        return v.column != 0
    if v.kind == "text":
        return F.length(v.column) > 0
    return F.lit(bool(v.items))


def _nan_free(c: Column) -> Column:
    """Null where a result isn't a finite number of the language."""
    return F.when(F.isnan(c), None).otherwise(c)


class _Compiler(ast.NodeVisitor):
    def __init__(self, names: dict[str, str]) -> None:
        self.names = names

    def generic_visit(self, node: ast.AST) -> Value:
        raise ExpressionError(f"{type(node).__name__} is not part of the filter language")

    def visit_Expression(self, node: ast.Expression) -> Value:
        return self.visit(node.body)

    def visit_Constant(self, node: ast.Constant) -> Value:
        value = node.value
        if isinstance(value, bool):
            return Value(F.lit(value), "flag", constant=value)
        if isinstance(value, (int, float)):
            return Value(F.lit(float(value)), "number", constant=value)
        if isinstance(value, str):
            return Value(F.lit(value), "text", constant=value)
        raise ExpressionError(f"constant {value!r} is not part of the filter language")

    def visit_Name(self, node: ast.Name) -> Value:
        if node.id not in self.names:
            raise ExpressionError(f"unknown name {node.id!r}; there are {sorted(self.names)}")
        text = node.id in TEXT
        return Value(F.col(self.names[node.id]) if text else F.col(self.names[node.id]).cast("double"), "text" if text else "number")

    def visit_List(self, node: ast.List | ast.Tuple) -> Value:
        return Value(None, "list", tuple(self.visit(e) for e in node.elts))

    visit_Tuple = visit_List

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Value:
        v = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return Value(~_truth(v), "flag")
        if isinstance(node.op, ast.USub):
            return Value(-_number(v), "number", constant=-v.constant if isinstance(v.constant, (int, float)) else None)
        if isinstance(node.op, ast.UAdd):
            return Value(_number(v), "number", constant=v.constant)
        raise ExpressionError("this operator is not part of the filter language")

    def visit_BinOp(self, node: ast.BinOp) -> Value:
        left, right = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Add) and left.kind == right.kind == "text":
            return Value(F.concat(left.column, right.column), "text")
        a, b = _number(left), _number(right)
        whole = F.floor(F.try_divide(a, b)).cast("double")
        ways = {
            ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a, b), ast.FloorDiv: lambda: whole,
            # the sign of the divisor: Spark's own remainder has that of the dividend
            ast.Mod: lambda: F.when(b != 0, a - b * whole), ast.Pow: lambda: self._power(a, b, right),
        }
        if type(node.op) not in ways:
            raise ExpressionError("this operator is not part of the filter language")
        return Value(ways[type(node.op)](), "number")

    def _power(self, a: Column, b: Column, exponent: Value) -> Column:
        if isinstance(exponent.constant, (int, float)) and abs(exponent.constant) > LARGEST_EXPONENT:
            raise ExpressionError(f"exponent beyond {LARGEST_EXPONENT}")
        # a negative base with a broken exponent and zero with a negative one have no real value
        return F.when((F.abs(b) <= LARGEST_EXPONENT) & ~((a == 0) & (b < 0)), _nan_free(F.pow(a, b)))

    def visit_BoolOp(self, node: ast.BoolOp) -> Value:
        values = [self.visit(v) for v in node.values]
        flags = [_truth(v) for v in values]
        out = flags[0]
        for f in flags[1:]:
            out = out & f if isinstance(node.op, ast.And) else out | f
        # every operand is evaluated, so one that can't be spoils the row
        there = F.lit(True)
        for f in flags:
            there = there & f.isNotNull()
        return Value(F.when(there, out), "flag")

    def visit_Compare(self, node: ast.Compare) -> Value:
        left, links = self.visit(node.left), []
        for op, comparator in zip(node.ops, node.comparators, strict=True):
            right = self.visit(comparator)
            links.append(self._link(op, left, right))
            left = right
        out = links[-1]
        for link in reversed(links[:-1]):  # a later link is looked at only where the ones before hold
            out = F.when(link, out).when(~link, F.lit(False))
        return Value(out, "flag")

    def _link(self, op: ast.cmpop, left: Value, right: Value) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            if right.kind == "text" and left.kind == "text":
                found = right.column.contains(left.column)
            elif right.kind == "list":
                found = F.lit(False)
                for item in right.items:
                    found = found | self._equal(left, item)
                found = F.when(_all_there([left, *(i for i in right.items if i.column is not None)]), found)
            else:
                raise ExpressionError("'in' needs a list or a text on its right")
            return ~found if isinstance(op, ast.NotIn) else found
        if isinstance(op, (ast.Eq, ast.NotEq)):
            same = self._equal(left, right)
            return ~same if isinstance(op, ast.NotEq) else same
        if (left.kind == "text") != (right.kind == "text") or "list" in (left.kind, right.kind):
            return F.lit(None).cast("boolean")  # an order of text and number: no row can be evaluated
        a, b = (left.column, right.column) if left.kind == "text" else (_number(left), _number(right))
        ways = {ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b}
        if type(op) not in ways:
            raise ExpressionError("this comparison is not part of the filter language")
        return ways[type(op)]

    def _equal(self, left: Value, right: Value) -> Column:
        if "list" in (left.kind, right.kind):
            return F.lit(False)
        if (left.kind == "text") != (right.kind == "text"):
            return F.when(_all_there([left, right]), F.lit(False))
        return left.column == right.column if left.kind == "text" else _number(left) == _number(right)

    def visit_IfExp(self, node: ast.IfExp) -> Value:
        test, then, other = _truth(self.visit(node.test)), self.visit(node.body), self.visit(node.orelse)
        kinds = {then.kind, other.kind}
        if kinds == {"text"}:
            a, b, kind = then.column, other.column, "text"
        elif kinds == {"flag"}:
            a, b, kind = then.column, other.column, "flag"
        else:
            a, b, kind = _number(then), _number(other), "number"
        return Value(F.when(test, a).when(~test, b), kind)

    def visit_Call(self, node: ast.Call) -> Value:
        name = node.func.id if isinstance(node.func, ast.Name) else None
        if name not in ("abs", "min", "max", "round", "int", "float", "bool") or node.keywords:
            raise ExpressionError("only abs, min, max, round, int, float and bool can be called")
        values = [self.visit(a) for a in node.args]
        if name in ("min", "max") and len(values) == 1 and values[0].kind == "list":
            values = list(values[0].items)
        if not values or name not in ("min", "max", "round") and len(values) != 1 or name == "round" and len(values) > 2:
            raise ExpressionError(f"{name} has the wrong number of arguments")
        if name == "bool":
            return Value(_truth(values[0]), "flag")
        if name in ("min", "max"):
            numbers = [_number(v) for v in values]
            best = numbers[0] if len(numbers) == 1 else (F.least if name == "min" else F.greatest)(*numbers)
            return Value(F.when(_all_there(values), best), "number")
        x = _number(values[0])
        if name == "abs":
            return Value(F.abs(x), "number")
        if name == "int":
            return Value(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"), "number")
        if name == "float":
            return Value(x, "number")
        places = values[1].constant if len(values) == 2 else 0
        if not isinstance(places, int):
            raise ExpressionError("round needs a whole number of places")
        return Value(F.bround(x, places), "number")


def compile_expression(expr: str, names: dict[str, str] | Iterable[str] = FEATURES) -> Column:
    """The expression as a boolean column: null where a row can't be evaluated. Raises ExpressionError where no row can be."""
    names = dict(names) if isinstance(names, dict) else {n: n for n in names}
    try:
        tree = ast.parse(expr.strip(), mode="eval")
    except (SyntaxError, ValueError) as e:
        raise ExpressionError(f"not an expression: {e}") from None
    return _truth(_Compiler(names).visit(tree))


def names_in(expr: str) -> set[str]:
    """The names that an expression uses; none if it is no expression."""
    try:
        return {n.id for n in ast.walk(ast.parse(expr.strip(), mode="eval")) if isinstance(n, ast.Name)}
    except (SyntaxError, ValueError):
        return set()


def check_expression(expr: str) -> str | None:
    """What is wrong with an expression, or None. No job runs."""
    try:
        compile_expression(expr)
    except ExpressionError as e:
        return str(e)
    return None


def with_kept(events: DataFrame, exprs: Iterable[str]) -> DataFrame:
    """Events with ``kept``: whether all expressions hold; one that can't be evaluated on a row doesn't."""
    kept = F.lit(True)
    for e in exprs:
        kept = kept & F.coalesce(compile_expression(e), F.lit(False))
    return events.withColumn("kept", kept)


def apply_filters(events: DataFrame, exprs: Iterable[str]) -> DataFrame:
    return with_kept(events, exprs).filter("kept").drop("kept")
