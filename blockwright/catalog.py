"""Registry of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockwright.operators import archive, bytes_stats, clips, codecs, images, matching, scalars, surface, texels

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (bytes_stats, archive, clips, matching, images, codecs, scalars, texels, surface)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
