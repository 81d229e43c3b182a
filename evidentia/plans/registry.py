"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from evidentia.plans import catalogue, checks, evidence, runs, sequence, streams, structure

DOMAINS = (structure, checks, catalogue, sequence, evidence, runs, streams)


def queries() -> dict:
    return {name: query for domain in DOMAINS for name, query in domain.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for domain in DOMAINS for name, sql in domain.SQL.items()}
