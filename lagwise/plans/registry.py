"""Registering a query together with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

#: Moves results off the ties that averages of two-digit values often end on, so that
#: two engines which differ in the last bit round alike.
NUDGE = 1e-8


def r(c, n: int = 6):
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, n)


def query_into(queries: dict, sqls: dict[str, str]):
    """A decorator that registers a query under its name. In its SQL every
    round(..., 6) AS or round(..., 4) AS gets the nudge of r()."""

    def query(sql: str | None = None, name: str = ""):
        def keep(f):
            queries[name or f.__name__] = f
            if sql:
                sqls[name or f.__name__] = re.sub(r", ([46])\) AS", r" + 1e-8, \1) AS", sql)
            return f

        return keep

    return query
