"""All queries of the library and the DuckDB SQL that states their results."""

from __future__ import annotations

from tabiya.plans import jobs, logs, records, structured, texts
from tabiya.plans.standins import Query

QUERIES: dict[str, Query] = {name: run for module in (structured, texts, logs, records, jobs) for name, run in module.CATALOGUE.queries.items()}
ORACLES: dict[str, str] = {name: sql for module in (structured, texts, logs, records, jobs) for name, sql in module.CATALOGUE.oracles.items()}
