"""Forward and reverse differentiation of straight-line programs, compiled to columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Primitive:
    """A function of columns and its partial derivative by each argument."""

    value: Callable[..., Column]
    partials: tuple[Callable[..., Column], ...]


PRIMITIVES: dict[str, Primitive] = {
    "add": Primitive(lambda a, b: a + b, (lambda a, b: F.lit(1.0), lambda a, b: F.lit(1.0))),
    "mul": Primitive(lambda a, b: a * b, (lambda a, b: b, lambda a, b: a)),
    "square": Primitive(lambda a: a * a, (lambda a: F.lit(2.0) * a,)),
    "ln": Primitive(lambda a: F.log(a), (lambda a: F.try_divide(F.lit(1.0), a),)),  # null where undefined
}

#: A program is a list of (output, primitive, inputs), in order of evaluation.
Program = list[tuple[str, str, tuple[str, ...]]]
# The two programs whose results are known.
DOUBLE_PLUS_SQUARED: Program = [("z1", "add", ("x1", "x1")), ("z2", "add", ("z1", "x2")), ("f", "square", ("z2",))]
LOG_OF_SQUARE: Program = [("z", "square", ("x",)), ("f", "ln", ("z",))]


def forward(df: DataFrame, program: Program) -> DataFrame:
    """Add a column for every output of the program; columns of ``df`` are its inputs."""
    for out, name, inputs in program:
        df = df.withColumn(out, PRIMITIVES[name].value(*[F.col(x) for x in inputs]))
    return df


def tangents(df: DataFrame, program: Program, by: str) -> DataFrame:
    """Add ``t_<name>``, the derivative of every variable by the input ``by``, carried forward with the values.

    A second way to the derivatives of ``backward``, to check them by.
    """
    names = list(dict.fromkeys(x for _, _, inputs in program for x in inputs))
    slopes: dict[str, Column] = {x: F.lit(1.0 if x == by else 0.0) for x in names}
    for out, name, inputs in program:
        args = [F.col(x) for x in inputs]
        terms = [partial(*args) * slopes[x] for x, partial in zip(inputs, PRIMITIVES[name].partials, strict=True)]
        slopes[out] = sum(terms[1:], terms[0])
    return df.select("*", *[slope.alias(f"t_{x}") for x, slope in slopes.items()])


def backward(df: DataFrame, program: Program, of: str = "f") -> DataFrame:
    """Add ``d_<name>``, the derivative of ``of`` by every variable, to rows that ``forward`` has completed.

    Contributions add up, so an input that is used twice counts twice. A
    variable that ``of`` doesn't depend on has derivative 0.
    """
    names = list(dict.fromkeys([x for _, _, inputs in program for x in inputs] + [out for out, _, _ in program]))
    adjoints: dict[str, Column] = {of: F.lit(1.0)}
    for out, name, inputs in reversed(program):
        if out not in adjoints:
            continue
        args = [F.col(x) for x in inputs]
        for x, partial in zip(inputs, PRIMITIVES[name].partials, strict=True):
            term = adjoints[out] * partial(*args)
            adjoints[x] = adjoints[x] + term if x in adjoints else term
    return df.select("*", *[adjoints.get(x, F.lit(0.0)).alias(f"d_{x}") for x in names])
