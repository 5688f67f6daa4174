"""Small frames as tables of a paper."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Letters that need a backslash in a table's cells.
ESCAPED = "&%$#_{}"


def cell(value: object, digits: int) -> str:
    if value is None:
        return "-"
    text = f"{value:,.{digits}f}" if isinstance(value, float) else f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else str(value)
    return "".join(f"\\{c}" if c in ESCAPED else c for c in text)


def latex(df: DataFrame, caption: str, label: str, digits: int = 2, most: int = 1000) -> str:
    """A report's rows (`most` at most: a table is to be read) as a table environment, numbers to the right."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no table")
    columns = "".join("l" if kind in ("string", "boolean") else "r" for _, kind in df.dtypes)
    lines = [r"\begin{table}[t]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{columns}}}", r"\hline"]
    lines += [" & ".join(cell(c, digits) for c in df.columns) + r" \\", r"\hline"]
    lines += [" & ".join(cell(v, digits) for v in r) + r" \\" for r in rows]
    return "\n".join([*lines, r"\hline", r"\end{tabular}", r"\end{table}"]) + "\n"
