"""Turns named queries that use each other into one statement with CTEs."""

from __future__ import annotations

import re


def compose(sql: str, named: dict[str, str]) -> str:
    """Prefix `sql` with every named query it needs, dependencies first."""
    ordered: list[str] = []
    entered: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"\b[tv]_\w+\b", text):
            if word in named and word not in entered:  # a recursive query names itself
                entered.add(word)
                visit(named[word])
                ordered.append(word)

    visit(sql)
    if not ordered:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({named[name].strip()})" for name in ordered)
    return f"WITH RECURSIVE {ctes}\n{sql.strip()}"
