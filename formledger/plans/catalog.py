"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from . import audits, endings, evidence, filesets, lists, live, packs, profiles, rebuilt, relations, reports, runs, values, wordfiles

_PARTS = (profiles, audits, runs, reports, live, values, packs, relations, evidence, rebuilt, lists, endings, wordfiles, filesets)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
