"""Registry of the library's own queries and their SQL oracles."""

from __future__ import annotations

from driftline.harness import detection, domain, relational
from driftline.workers import with_workers

MODULES = [detection, relational, domain]


def queries():
    return {name: with_workers(f) for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
