"""Names of helper columns."""

from __future__ import annotations


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    while name in columns:
        name = "_" + name
    return name
