"""Registry of named queries: Spark plan + DuckDB oracle text.

Each registered function takes ``(spark, sf_dir)`` and returns a lazy
DataFrame built from the driver tables through the adapter views.  The oracle
is the same question in DuckDB SQL; both alias every computed column the same
way and round doubles to 6 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pubsift.plans.oracle import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, ctes: str = "", recursive: bool = False):
    """Register a query; ``oracle`` is the DuckDB body (adapter CTEs are added)."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle, ctes, recursive)
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from pubsift.plans import (  # noqa: F401
        q_search, q_corpus, q_text, q_ranking, q_labels, q_embeddings, q_misc, q_sources, q_stream, q_models, q_extra,
    )
