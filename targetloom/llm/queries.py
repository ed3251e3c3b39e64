"""Named queries of this folder: one thin ``opN_<name>`` per operator, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from targetloom.llm import registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = registry.QUERIES
CHECKS: dict[str, str] = registry.CHECKS

from targetloom.llm import (  # noqa: E402,F401  each module registers its query
    content_sort, debruijn, grid_order, manifest, packing, piece_codec, prefix_orders, prefix_trie, suffix_arrays, token_counts, token_files, weak_labels, web_archive,
)
