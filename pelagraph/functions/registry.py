"""Where the scalar functions are collected."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

SCALARS: dict[str, Callable[..., Column]] = {}


def register(*names: str):
    """Add a function under its names; it takes the context first."""

    def add(f):
        for n in names:
            SCALARS[n] = f
        return f

    return add


def plain(**functions: Callable[..., Column]) -> None:
    """Functions that do not need the context."""
    for n, f in functions.items():
        SCALARS[n] = lambda ctx, *a, f=f: f(*a)


def alias(**names: str) -> None:
    """alias(target='other names') after the target is there."""
    for target, others in names.items():
        for n in others.split():
            SCALARS[n] = SCALARS[target]


class Context:
    """df: what the columns belong to; literals: each argument's literal value, or ``Context.NONE``."""

    NONE = object()

    def __init__(self, df: DataFrame | None, literals: list[Any] | None = None, session: Any = None):
        self.df, self.literals, self.session = df, literals or [], session

    def literal(self, i: int) -> Any:
        if i >= len(self.literals) or self.literals[i] is Context.NONE:
            raise ValueError(f"argument {i + 1} has to be a literal")
        return self.literals[i]

    def type(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("c")).schema[0].dataType

    def is_text(self, c: Column) -> bool:
        return isinstance(self.type(c), T.StringType)
