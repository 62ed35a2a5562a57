"""Operators for large training-data pipelines. Nothing outside this package imports it."""

from . import queries as queries
