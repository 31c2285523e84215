"""Compares results of two engines as sorted rows."""

from __future__ import annotations

import pandas as pd


def difference(a: pd.DataFrame, b: pd.DataFrame, within: float = 2e-6) -> str:
    """What differs between two tables apart from the order of rows and columns; empty if nothing does."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    columns = sorted(a.columns)
    order = [c for c in columns if not pd.api.types.is_float_dtype(a[c]) and not pd.api.types.is_float_dtype(b[c])]
    order += [c for c in columns if c not in order]
    a, b = (x[columns].sort_values(order, key=lambda s: s.astype(str) if s.dtype == object else s).reset_index(drop=True) for x in (a, b))
    for c in columns:
        if pd.api.types.is_float_dtype(a[c]) or pd.api.types.is_float_dtype(b[c]):
            x, y = a[c].astype(float), b[c].astype(float)
            wrong = ~((x - y).abs().le(within + 1e-9 * y.abs()) | (x.isna() & y.isna()))
        else:
            wrong = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if wrong.any():
            return f"{c}: {wrong.sum()} of {len(a)} rows, {a[c][wrong].iloc[0]} and {b[c][wrong].iloc[0]}"
    return ""
