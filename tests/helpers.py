"""Small helpers to look at results and plans."""

import contextlib
import io

EXPORTS = "year long, state string, headingCode string, heading string, metricFOB long"


def as_set(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def by_key(df, key, *values):
    """Rows as a dict; a single value column is not wrapped in a tuple."""
    found = {}
    for row in df.collect():
        assert row[key] not in found, f"duplicate {row[key]}"
        picked = tuple(row[v] for v in values)
        found[row[key]] = picked[0] if len(values) == 1 else picked
    return found


def explain(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()
