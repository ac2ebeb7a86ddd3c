"""Result tables as files, and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_tables(tables: dict[str, DataFrame], directory: str) -> list[str]:
    """Each (small) result table as one CSV with a header, in a folder of its own."""
    paths = []
    for name, table in tables.items():
        path = f"{directory.rstrip('/')}/{name}"
        table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        paths.append(path)
    return paths


def report(tables: dict[str, DataFrame], rows: int = 20) -> str:
    """The tables as text, for a console; one that has more rows than are shown says so."""
    parts = []
    for name, table in tables.items():
        found = table.limit(rows + 1).collect()
        lines = ["  ".join(f"{v:.6g}" if isinstance(v, float) else str(v) for v in row) for row in found[:rows]]
        more = [f"... and more rows than the {rows} shown"] if len(found) > rows else []
        parts.append("\n".join([name, "  ".join(table.columns), *lines, *more]))
    return "\n\n".join(parts)
