"""Filters as columns against the same expressions in Python."""

import random

import pytest

from zonestudy.functions.expressions import FEATURES, ExpressionError, apply_filters, check_expression, compile_expression

ATOMS = ["hour", "dow", "atr", "bias", "gap_atr", "3", "0", "2.5", "-1", "test_number"]


def grow(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(ATOMS)
    a, b, c = (grow(rng, depth - 1) for _ in range(3))
    return rng.choice([f"({a} + {b})", f"({a} - {b})", f"({a} * {b})", f"({a} / {b})", f"({a} // {b})", f"({a} % {b})", f"({a} < {b})", f"({a} >= {b} > {c})",
                       f"({a} and {b})", f"({a} or {b})", f"(not {a})", f"({a} if {b} else {c})", f"abs({a})", f"min({a}, {b})", f"max({a}, {b}, {c})", f"({a} in [{b}, {c}])", f"(-{a})"])


def in_python(expr, env):
    """As the language defines it: and/or look at all operands and give a flag; an error drops the row."""
    import ast

    class Strict(ast.NodeTransformer):
        def visit_BoolOp(self, node):
            self.generic_visit(node)
            name = "all_" if isinstance(node.op, ast.And) else "any_"
            return ast.Call(ast.Name(name, ast.Load()), node.values, [])

    tree = ast.fix_missing_locations(Strict().visit(ast.parse(expr, mode="eval")))
    try:
        return bool(eval(compile(tree, "e", "eval"), {"all_": lambda *x: all(x), "any_": lambda *x: any(x)}, dict(env)))
    except Exception:
        return False


def test_random_expressions(spark):
    rng = random.Random(11)
    envs = [{"hour": float(rng.randrange(24)), "dow": float(rng.randrange(7)), "atr": rng.choice([0.5, 2.0, -1.5, 0.0]), "bias": rng.choice([1.0, -1.0]), "gap_atr": rng.choice([0.0, 0.25, -3.0]), "test_number": 1.0} for _ in range(12)]
    df = spark.createDataFrame([(i, *e.values()) for i, e in enumerate(envs)], "i int, " + ", ".join(f"{k} double" for k in envs[0]))
    exprs = [grow(rng, 3) for _ in range(150)]
    for part in range(0, len(exprs), 30):
        rows = df.select("i", *[compile_expression(e, list(envs[0])).alias(f"c{k}") for k, e in enumerate(exprs[part : part + 30])]).collect()
        for r in rows:
            for k, e in enumerate(exprs[part : part + 30]):
                assert bool(r[f"c{k}"]) == in_python(e, envs[r.i]), (e, envs[r.i])


def test_text_and_functions(spark):
    df = spark.createDataFrame([("RTH", 2.5, 3.0), ("ASIA", -2.5, 4.0)], "session string, atr double, hour double")
    one = lambda e: [r[0] for r in df.select(compile_expression(e, ["session", "atr", "hour"])).collect()]
    assert one("session in ['RTH', 'AFTER']") == [True, False] and one("session not in 'ASIA'") == [True, False]
    assert one("round(atr) == 2 or int(atr) == -2") == [True, True] and one("bool(atr) and float(hour) ** 2 > 10") == [False, True]
    assert one("session > 1") == [None, None] and one("session == 1") == [False, False] and one("hour ** -1 < 0.3") == [False, True]
    assert apply_filters(df, ["hour / (hour - 3) > 0"]).count() == 1 and apply_filters(df, []).count() == 2


@pytest.mark.parametrize("expr", ["foo > 1", "__import__('os')", "session.upper()", "lambda: 1", "hour = 1", "9 ** 99", "[x for x in [1]]", "'a' * 3", "abs()", "open('x')", ""])
def test_refused(spark, expr):
    assert check_expression(expr)
    with pytest.raises(ExpressionError):
        compile_expression(expr)


def test_every_feature_is_a_name(spark):
    assert len(FEATURES) == 25 and all(check_expression(f"{n} == 1") is None for n in FEATURES)
