"""Helpers for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: Spark may otherwise copy it into a lambda and compute it at every step.

    It also keeps a long chain of patterns out of generated code, whose methods it would outgrow.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
