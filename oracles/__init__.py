"""Independent DuckDB SQL for the registered queries: plain windows and nested selects."""

from __future__ import annotations

import re

from oracles.base import CTES


def compose(final: str) -> str:
    """``final`` preceded by the common table expressions it needs, in order."""
    own = ""
    if final.startswith("/*fold*/"):
        own, final = final.removeprefix("/*fold*/").split("/*end*/")
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(own + final)
    parts = [f"{name} AS (\n{CTES[name]}\n)" for name in CTES if name in needed] + ([own] if own else [])
    return ("WITH " + ("RECURSIVE " if own else "") + ",\n".join(parts) + "\n" if parts else "") + final
