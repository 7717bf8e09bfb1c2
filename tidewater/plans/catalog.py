"""The registered queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans import documents, mapped, matching, records, snapshots, sourced, stored, texts, variants

MODULES = (snapshots, records, texts, matching, documents, sourced, variants, mapped, stored)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE.items()}
