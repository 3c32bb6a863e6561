"""SQL text helpers: literals, messages from templates."""

from __future__ import annotations

import re


def literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def time_sql(value: int | str) -> str:
    """An evaluation time, given as epoch milliseconds or as a SQL expression."""
    return f"{value}L" if isinstance(value, int) else f"({value})"


def message_sql(template: str, **parts: str) -> str:
    """SQL for a message: ``{x}`` stands for column ``x``, or for the SQL given as ``x``.

    What is null shows as nothing.
    """
    pieces = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            pieces.append(f"coalesce(string({parts.get(piece, piece)}), '')")
        elif piece:
            pieces.append(literal(piece))
    return f"concat({', '.join(pieces)})"
