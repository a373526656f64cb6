"""Rating replay of one pool, by levels of dependency, with a stored end state.

A game depends on the game before it of each of its teams, so its level is one more than
the higher of theirs. Games of one level have no team in common and are replayed together:
their teams' ratings come from a keyed table by joins, and what the level changes goes back
to it. Levels of few games, as a pool of few teams has, would each be a job of little work,
so neighbouring ones are replayed as one band: a task that reads the band's games in
order, with the ratings that its teams have before, and holds a bounded number of games."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.staging import broadcast_if_small, stage, unstage

from . import scans
from .ratings import SCALE, START, STEP

#: Levels of more games are replayed by joins; narrower ones together, up to BAND games.
WIDE, BAND = 50_000, 200_000
#: Games of a band that is cut from the order itself.
PLACES = 500_000


def with_levels(games: DataFrame, game: str, order: Sequence[str], home: str, away: str) -> DataFrame:
    """games plus level, from 1; null for games without both teams or of a team with itself.

    order (total) and game (unique) tell the games apart. A level starts as the higher of
    both teams' numbers of games up to it. Then each team's games are put on rising levels
    by one running maximum, and a game on the higher of its teams', until nothing moves."""
    able = F.col(home).isNotNull() & F.col(away).isNotNull() & (F.col(home) != F.col(away))
    sides = games.where(able).select(game, *[c for c in order if c != game], F.explode(F.array(home, away)).alias("_team"))
    by_team = Window.partitionBy("_team").orderBy(*order)
    cur = stage(sides.select(game, "_team", F.row_number().over(by_team).cast("long").alias("_seq")).withColumn("_level", F.col("_seq")))
    so_far = Window.partitionBy("_team").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    last = None
    while True:
        rising = cur.withColumn("_level", F.max(F.col("_level") - F.col("_seq")).over(so_far) + F.col("_seq"))
        both = rising.withColumn("_level", F.max("_level").over(Window.partitionBy(game)))
        before, cur = cur, stage(both)
        unstage(before)
        now = cur.agg(F.sum("_level")).first()[0]  # levels only rise
        if now == last:
            break
        last = now
    found = cur.groupBy(game).agg(F.max("_level").alias("level"))
    return games.join(found, game, "left")


def _bands(sizes: list[tuple[int, int]], wide: int, band: int) -> list[tuple[int, int, bool]]:
    """First and last level of each band, and whether it is one wide level."""
    out: list[tuple[int, int, bool]] = []
    room = 0
    for level, n in sizes:
        if n > wide:
            out.append((level, level, True))
            room = 0
        elif n <= room:
            out[-1] = (out[-1][0], level, False)
            room -= n
        else:
            out.append((level, level, False))
            room = max(band - n, 0)
    return out


def replay_by_levels(games: DataFrame, game: str, order: Sequence[str], home: str, away: str, home_won: str, state: DataFrame | None = None,
                     start: float = START, step: float = STEP, scale: float = SCALE, wide: int = WIDE, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """games plus home_rating and away_rating before each game, and the ratings (team,
    rating) after all of them, which a later call takes as state to go on from.

    Equal to ratings.rating_replay of one pool. home_won null counts as lost; games without
    both teams, or of a team with itself, get null ratings and change nothing. Teams that
    state doesn't have begin at start. Only the levels' numbers of games come to the driver."""
    levelled = stage(with_levels(games, game, order, home, away))
    kind = dict(levelled.dtypes)[home]
    ratings = stage(state.select(F.col("team").cast(kind), F.col("rating").cast("double"))) if state is not None else None
    sizes = [(r.level, r.n) for r in levelled.where("level is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy("level").collect()]
    done: list[DataFrame] = []
    expected = 1 / (1 + F.pow(F.lit(10.0), (F.col("_a") - F.col("_h")) / scale))
    change = step * (F.when(F.col(home_won) == 1, 1.0).otherwise(0.0) - expected)
    at_once = lambda p: p.select("_game", "level", "_home", "_away", "_h", "_a", (F.col("_h") + change).alias("_h2"), (F.col("_a") - change).alias("_a2"))
    for first, last, alone in _bands(sizes, wide, band):
        part = levelled.where(F.col("level").between(first, last)).select(F.col(game).alias("_game"), "level", F.col(home).alias("_home"), F.col(away).alias("_away"), home_won)
        replay = at_once if alone else lambda p: _in_order(p, home_won, step, scale)
        rated, ratings = _round(part, ratings, replay, start, game)
        done.append(rated)
    if not done:
        return _unrated(levelled.drop("level"), kind, ratings)
    found = done[0]
    for df in done[1:]:
        found = found.unionByName(df)
    return levelled.join(found, game, "left").drop("level"), ratings


def replay_in_bands(games: DataFrame, game: str, order: Sequence[str], home: str, away: str, home_won: str, state: DataFrame | None = None,
                    start: float = START, step: float = STEP, scale: float = SCALE, band: int = PLACES) -> tuple[DataFrame, DataFrame]:
    """What replay_by_levels gives, without looking for levels: the order itself is cut into
    bands of so many games, and a task replays a band with the ratings that its teams have
    before. Rounds grow with games / band, where levels take a round for each link of the
    longest chain of games; but one task works at a time, so levels are for pools whose games
    take longer than that to go through. order begins with a date or number that many games share."""
    games = stage(games)
    kind = dict(games.dtypes)[home]
    able = F.col(home).isNotNull() & F.col(away).isNotNull() & (F.col(home) != F.col(away))
    own = scans.cut(games.where(able).select(*dict.fromkeys([game, *order, home, away, home_won])), [], order, order[0]).df
    own = own.select(F.col(game).alias("_game"), F.col("_i").alias("level"), F.col(home).alias("_home"), F.col(away).alias("_away"), home_won, F.floor(F.col("_i") / band).alias("_band"))
    own = stage(own.repartition("_band"))  # a band's games are in one file, so a round reads little else
    last = own.agg(F.max("_band")).first()[0]
    ratings = stage(state.select(F.col("team").cast(kind), F.col("rating").cast("double"))) if state is not None else None
    found = None
    for b in range(0 if last is None else last + 1):
        rated, ratings = _round(own.where(F.col("_band") == b).drop("_band"), ratings, lambda part: _in_order(part, home_won, step, scale), start, game)
        found = rated if found is None else found.unionByName(rated)
    if found is None:
        return _unrated(games, kind, ratings)
    return games.join(found, game, "left"), ratings


def _unrated(games: DataFrame, kind: str, ratings: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    nothing = F.lit(None).cast("double")
    none = games.sparkSession.createDataFrame([], f"team {kind}, rating double")
    return games.withColumns({"home_rating": nothing, "away_rating": nothing}), none if ratings is None else ratings


def _round(part: DataFrame, ratings: DataFrame | None, replay: Callable[[DataFrame], DataFrame], start: float, game: str) -> tuple[DataFrame, DataFrame]:
    """The games of part, by _game and level, with the ratings before each, and all teams' ratings after them."""
    for side in ("home", "away"):
        if ratings is None:
            part = part.withColumn(f"_{side[0]}", F.lit(start))
        else:
            known = ratings.select(F.col("team").alias(f"_{side}"), F.col("rating").alias(f"_{side[0]}"))
            part = part.join(broadcast_if_small(known), f"_{side}", "left").fillna(start, [f"_{side[0]}"])
    rated = stage(replay(part))
    ends = rated.select("level", F.explode(F.array(*[F.struct(F.col(f"_{s}").alias("team"), F.col(f"_{s[0]}2").alias("rating")) for s in ("home", "away")])).alias("s"))
    ends = ends.groupBy("s.team").agg(F.max_by("s.rating", "level").alias("rating"))
    if ratings is not None:
        ends = ratings.join(ends.select("team"), "team", "left_anti").unionByName(ends)
    now = stage(ends)
    if ratings is not None:
        unstage(ratings)
    return rated.select(F.col("_game").alias(game), F.col("_h").alias("home_rating"), F.col("_a").alias("away_rating")), now


def _in_order(part: DataFrame, home_won: str, step: float, scale: float) -> DataFrame:
    """The games of a band of narrow levels, replayed one after the other in one task."""

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict = {}
        for b in batches:
            rows = []
            for h, a, won, rh, ra in zip(b["_home"], b["_away"], b[home_won], b["_h"], b["_a"], strict=True):
                rh, ra = now.get(h, rh), now.get(a, ra)
                change = step * ((1.0 if won == 1 else 0.0) - 1 / (1 + 10 ** ((ra - rh) / scale)))
                now[h], now[a] = rh + change, ra - change
                rows.append((rh, ra, rh + change, ra - change))
            out = b[["_game", "level", "_home", "_away"]].copy()
            out[["_h", "_a", "_h2", "_a2"]] = rows
            yield out

    kinds = dict(part.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in ("_game", "level", "_home", "_away")], *[f"{c} double" for c in ("_h", "_a", "_h2", "_a2")]])
    # one band is at most BAND games, or one level of at most WIDE
    return part.repartition(1).sortWithinPartitions("level", "_game").mapInPandas(replay, schema)
