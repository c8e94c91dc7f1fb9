"""Hiding the private parts of notes and reflections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns below define what counts as private.
# A block runs to its closing mark or, left open, to the end of the text.
_BLOCK = r"(?s)/\*.*?(?:\*/|\z)"
# Cutting blocks out can bring a new opening mark together; it hides the rest.
_REST = r"(?s)/\*.*"
_EDGE = " \t\n"


def hide_blocks(text: Column) -> Column:
    """Text without ``/* ... */`` blocks, trimmed; null when nothing is left.

    Taking an unclosed block in the same alternative keeps one left-to-right
    pass, so a long text full of opening marks costs linear time.
    """
    shown = F.regexp_replace(F.regexp_replace(text, _BLOCK, ""), _REST, "")
    return F.nullif(F.trim(shown, F.lit(_EDGE)), F.lit(""))


def hide_lines(text: Column) -> Column:
    """Older rule: drop the lines that begin with ``//`` after blanks."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~F.ltrim(line).startswith("//"))
    return F.nullif(F.array_join(kept, "\n"), F.lit(""))


def hide_private(text: Column, mode: str = "blocks") -> Column:
    rules = {"blocks": hide_blocks, "lines": hide_lines}
    if mode not in rules:
        raise ValueError(f"unknown redaction mode {mode!r}")
    return rules[mode](text)
