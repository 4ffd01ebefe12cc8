"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable


class Plan:
    """Queries of one area: name to function of (spark, sf_dir), and name to SQL."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add
