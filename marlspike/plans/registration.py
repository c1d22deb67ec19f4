"""How a module of queries lists them."""

from __future__ import annotations


class Registry:
    """Queries by name, and for those that SQL can express, their SQL."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(function):
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return add
