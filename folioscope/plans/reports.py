"""Small text tables of metrics, rendered on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from folioscope.errors import BenchmarkError, EvaluationError


def _columns(rows: Sequence[Sequence[str]], left: int = 0) -> list[list[str]]:
    """Cells padded to their column's width; the first ``left`` columns to the left."""
    padded = []
    for place, cells in enumerate(zip(*rows)):
        width = max(map(len, cells))
        padded.append([c.ljust(width) if place < left else c.rjust(width) for c in cells])
    return [list(row) for row in zip(*padded)]


def metric_grid(values: Mapping[str, float], metrics: Sequence[str], cutoffs: Sequence[int]) -> str:
    """A grid with a row per cutoff, a column per family and four decimals."""
    rows = [["k", *metrics]]
    for k in cutoffs:
        try:
            rows.append([str(k), *(f"{values[f'{m}@{k}']:.4f}" for m in metrics)])
        except KeyError as error:
            raise EvaluationError(f"no value for {error.args[0]}") from None
    cells = _columns(rows)
    rule = "+" + "+".join("-" * (len(c) + 2) for c in cells[0]) + "+"
    text = ["| " + " | ".join(r) + " |" for r in cells]
    return "\n".join([rule, text[0], rule.replace("-", "="), *(line for row in text[1:] for line in (row, rule))])


def comparison_table(results: Sequence[tuple[str, Mapping[str, float]]], metrics: Sequence[str], cutoffs: Sequence[int]) -> str:
    """A row per experiment, a column per family and cutoff, with a rule below the heads."""
    wanted = [f"{m}@{k}" for m in metrics for k in cutoffs]
    lacking = [(label, name) for label, values in results for name in wanted if name not in values]
    if lacking:
        raise BenchmarkError("no value for " + ", ".join(f"{name} of {label!r}" for label, name in lacking))
    rows = [["Experiment", *wanted], *([label, *(format(values[name], ".4f") for name in wanted)] for label, values in results)]
    head, *body = ["  ".join(r) for r in _columns(rows, left=1)]
    return "\n".join([head, "-" * len(head), *body])
