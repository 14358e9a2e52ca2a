"""Query registry: a Spark callable and, where possible, an independent SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cueloom.plans.fixtures import SQL_VIEWS, Fixtures
from cueloom.session import ship_package


@dataclass(frozen=True)
class Entry:
    build: Callable[[Fixtures], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def with_views(sql: str) -> str:
    """Prefix the fixture views a text uses, in dependency order."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_[a-z_]+\b", text):
            if name in SQL_VIEWS and name not in used:
                need(SQL_VIEWS[name])
                if name not in used:
                    used.append(name)

    need(sql)
    if not used:
        return sql
    views = ",\n".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in used)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def query(name: str, sql: str | None = None):
    def keep(build: Callable[[Fixtures], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query registered twice: {name}")
        ENTRIES[name] = Entry(build, with_views(sql) if sql else None)
        return build

    return keep


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Entry):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return entry.build(Fixtures(spark, sf_dir))

        return run

    return {name: bind(entry) for name, entry in ENTRIES.items()}


def sql_texts() -> dict[str, str]:
    return {name: entry.sql for name, entry in ENTRIES.items() if entry.sql}
