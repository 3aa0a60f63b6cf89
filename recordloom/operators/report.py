"""Textual reports of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def markdown(df: DataFrame, rows: int = 200) -> str:
    """A Markdown table of the first rows of a report, which is small by its nature (a board, a list of piles)."""
    cell = lambda v: "n/a" if v is None else (f"{v:.3f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", "\\|"))
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in df.limit(rows).collect()]) + "\n"
