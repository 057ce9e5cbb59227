"""Queries by capability, each with its SQL where SQL can express it."""

from . import checks, jobs, locks, privacy, prompts, streams

PARTS = (privacy, checks, prompts, jobs, locks, streams)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
