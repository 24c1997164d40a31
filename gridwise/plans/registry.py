"""All queries outside the subpackage for documents: name -> (function of session and directory, SQL or None)."""

from __future__ import annotations

from gridwise.fixtures import in_duckdb
from gridwise.plans import canonical, denoised, design, groups, linear, models, resampled, selection, series, sources

MODULES = [selection, series, design, groups, models, linear, sources, resampled, canonical, denoised]


def registered() -> dict:
    out: dict = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


def queries() -> dict:
    return {name: run for name, (run, _) in registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: in_duckdb(sql) for name, (_, sql) in registered().items() if sql}
