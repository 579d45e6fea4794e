"""Functions for SQL sessions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import keywords
from . import numbers, stats, url


def register_udfs(spark: SparkSession) -> None:
    """url_key, norm_number, extract_numbers, slugify, fisher_p."""
    for name, f in (("url_key", url.url_key), ("norm_number", numbers.norm_number), ("extract_numbers", numbers.extract_numbers), ("slugify", keywords.slugify), ("fisher_p", stats.fisher_p)):
        spark.udf.register(name, f)
