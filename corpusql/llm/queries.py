"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from corpusql.llm import problem_queries as q

QUERIES = {name: f for name, f in vars(q).items() if name[:1] == "p" and name[1:2].isdigit()}
SQL = q.SQL
