"""Functions that need Python: a calculator, tool turns and token choice, in Arrow batches."""

from __future__ import annotations

import ast
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos}
MOST_CHARACTERS = 500


def calculate(expression: str | None) -> str | None:
    """The value of an arithmetic expression, or of ``'text'.count('x')``; null for anything else. Nothing is ever evaluated as code."""
    if expression is None or len(expression) > MOST_CHARACTERS:
        return None

    def value(node: ast.AST) -> float | int:
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.operand))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "count" and not node.keywords and len(node.args) == 1:
            parts = (node.func.value, node.args[0])
            if all(isinstance(p, ast.Constant) and isinstance(p.value, str) for p in parts):
                return parts[0].value.count(parts[1].value)
        raise ValueError("not allowed")

    try:
        text = expression.strip()
        plain = text if "'" in text or '"' in text else text.replace(",", "")
        return str(value(ast.parse(plain, mode="eval")))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


def calculated(expression: Column) -> Column:
    def of(values: pd.Series) -> pd.Series:
        return values.map(calculate)

    return F.pandas_udf(of, "string")(expression)


def with_tool_output(ids: Column, begin: int, end: int, out: int, out_end: int) -> Column:
    """Byte tokens in which each python stretch is followed by its forced output, where it has a value."""

    def one(tokens: list[int]) -> list[int]:
        done: list[int] = []
        held: list[int] | None = None
        for token in tokens:
            done.append(token)
            if token == begin:
                held = []
            elif token == end and held is not None:
                result = calculate(bytes(held).decode("utf-8", "replace"))
                if result is not None:
                    done += [out, *result.encode(), out_end]
                held = None
            elif held is not None and 0 <= token < 256:
                held.append(token)
        return done

    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else one([int(x) for x in v]))

    return F.pandas_udf(of, "array<int>")(ids)


def chosen_token(logits: Column, seed: Column, temperature: float, top_k: int | None) -> Column:
    """Index of the next token: the greatest for temperature 0, else drawn from the softmax of the top k, by the row's seed."""

    def one(values: np.ndarray, seed_: int) -> int:
        x = np.asarray(values, float)
        if temperature == 0:
            return int(x.argmax())
        if top_k is not None and top_k < len(x):
            x = np.where(x >= np.sort(x)[-top_k], x, -np.inf)
        p = np.exp((x - x.max()) / temperature)
        return int(np.random.default_rng(abs(int(seed_))).choice(len(x), p=p / p.sum()))

    def of(values: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([one(v, s) for v, s in zip(values, seeds, strict=True)])

    return F.pandas_udf(of, "int")(logits, seed)
