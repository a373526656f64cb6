"""Registered queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from lagwise.plans import embedding_queries, model_queries, player_queries, team_queries


def queries() -> dict:
    return {**team_queries.Q, **player_queries.Q, **model_queries.Q, **embedding_queries.Q}


def oracle_sql() -> dict[str, str]:
    return {**team_queries.SQL, **player_queries.SQL, **model_queries.SQL, **embedding_queries.SQL}
