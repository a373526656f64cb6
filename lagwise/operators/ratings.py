"""Rating replay: games in order, each changing its two teams' ratings (Elo)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, STEP, SCALE = 1500.0, 20.0, 400.0


def rating_replay(games: DataFrame, pool: str, order: Sequence[str], home: str, away: str, home_won: str, start: float = START,
                  step: float = STEP, scale: float = SCALE) -> DataFrame:
    """games plus home_rating and away_rating before each game.

    Pools have separate ratings and run side by side; within a pool games depend on
    each other and run one after the other, in the order given (which must be total).
    A task reads its pools' games as a sorted stream and holds only one pool's current
    ratings, never the games. home_won null counts as lost; games without both teams
    get null ratings and change nothing."""
    schema = T.StructType([*games.schema.fields, T.StructField("home_rating", T.DoubleType()), T.StructField("away_rating", T.DoubleType())])

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rating = None, {}
        for b in batches:
            before: list[tuple] = []
            for p, h, a, won in zip(b[pool], b[home], b[away], b[home_won], strict=True):
                if p != now:
                    now, rating = p, {}
                if pd.isna(h) or pd.isna(a):
                    before.append((None, None))
                    continue
                rh, ra = rating.get(h, start), rating.get(a, start)
                before.append((rh, ra))
                change = step * ((1.0 if won == 1 else 0.0) - 1 / (1 + 10 ** ((ra - rh) / scale)))
                rating[h], rating[a] = rh + change, ra - change
            yield b.assign(home_rating=[x for x, _ in before], away_rating=[x for _, x in before])

    return games.repartition(F.col(pool)).sortWithinPartitions(pool, *order).mapInPandas(replay, schema)


def by_team(replayed: DataFrame, game: str, home: str, away: str) -> DataFrame:
    """game, team, rating: two rows for each replayed game, to attach to rows of teams."""
    sides = F.array(*[F.struct(F.col(t).alias("team"), F.col(f"{s}_rating").alias("rating")) for s, t in (("home", home), ("away", away))])
    return replayed.select(game, F.explode(sides).alias("_s")).select(game, "_s.team", "_s.rating")
