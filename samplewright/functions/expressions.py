"""Formulas over named quantities as Spark columns.

A formula is written with + - * / ^, unary minus, parentheses, numbers, names
and the functions sin, cos, tan, sqrt, exp, log, log10 and pow. Python's own
grammar reads it (^ is a power, right to left, and binds closer than the minus
before it), so nothing is parsed here: the tree is turned into one Column, which
Spark folds into the plan of the join. What has no value (division by zero, the
root or logarithm of what is too small) is null.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.operators.resampling import Keys


def _number_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


FUNCTIONS = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "log": F.log, "log10": F.log10,
    "sqrt": lambda x: _number_or_null(F.sqrt(x)), "pow": lambda x, y: _number_or_null(F.pow(x, y)),
}
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide, ast.Pow: FUNCTIONS["pow"]}


def symbols(formula: str) -> set[str]:
    """Names of the quantities in a formula."""
    tree = ast.walk(ast.parse(formula.replace("^", "**").strip(), mode="eval"))
    return {n.id for n in tree if isinstance(n, ast.Name)} - set(FUNCTIONS)


def column(formula: str, values: Mapping[str, Column]) -> Column:
    """The formula as a Column; a name without a value, or anything else than a formula, is an error."""

    def of(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return of(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in values:
                raise ValueError(f"no value for {node.id!r} in {formula!r}")
            return values[node.id]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -of(node.operand) if isinstance(node.op, ast.USub) else of(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](of(node.left), of(node.right))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords:
            return FUNCTIONS[node.func.id](*map(of, node.args))
        raise ValueError(f"not part of a formula: {ast.unparse(node)!r} in {formula!r}")

    return of(ast.parse(formula.replace("^", "**").strip(), mode="eval"))


def applied(df: DataFrame, formula: str) -> DataFrame:
    """df with v replaced by a formula of x, its old value; the formula must hold x and nothing else."""
    if symbols(formula) != {"x"}:
        raise ValueError(f"the formula must be of x alone: {formula!r}")
    return df.withColumn("v", column(formula, {"x": F.col("v")}))


def calculated(formula: str, quantities: Mapping[str, DataFrame], keys: Keys) -> DataFrame:
    """(keys, v): the formula of quantities (keys, v) at equal keys, central rows (s = -1) included.

    A key that not all of the quantities have is an error when the result is read.
    """
    names = sorted(symbols(formula))
    if missing := [n for n in names if n not in quantities]:
        raise ValueError(f"no value for {', '.join(missing)} in {formula!r}")
    if not names:
        raise ValueError(f"no quantity in {formula!r}")
    tagged = None
    for k, name in enumerate(names):
        rows = quantities[name].select(*keys, F.lit(k).alias("_k"), "v")
        tagged = rows if tagged is None else tagged.unionByName(rows)
    # One grouping for all quantities, whose partial sums are taken before the shuffle.
    held = tagged.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.max(F.when(F.col("_k") == k, F.col("v"))).alias(f"_{k}") for k in range(len(names))))
    at = F.concat_ws(", ", *(F.concat(F.lit(f"{k} = "), F.col(k).cast("string")) for k in keys))
    value = column(formula, {n: F.col(f"_{k}") for k, n in enumerate(names)})
    clash = F.raise_error(F.concat(F.lit(f"not one value of each of {', '.join(names)} at "), at)).cast("double")
    return held.select(*keys, F.when(F.col("_n") == len(names), value).otherwise(clash).alias("v"))
