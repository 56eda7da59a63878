"""The queries this repository answers, each beside its SQL meaning."""

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if SQL can say it, the SQL that says the same."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    from passim.registry import corpus, evaluation, index, keyword, limits, routed, streams, texts, vectors  # noqa: F401
