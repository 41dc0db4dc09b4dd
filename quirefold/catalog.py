"""Registered queries and the SQL text that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import business, intake, ledger, pages, redaction, rules

FAMILIES = (ledger, redaction, pages, business, rules, intake)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _family in FAMILIES:
    QUERIES |= _family.QUERIES
    ORACLES |= _family.ORACLES
