"""Two rows of one game: opponents, sides and home-minus-away differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def only_pairs(df: DataFrame, game: str) -> DataFrame:
    """The rows of games that have exactly two."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(game))).where("_n = 2").drop("_n")


def side(matchup: str, home: str = " vs. ", away: str = " @ ") -> Column:
    """'home' or 'away' by the text that stands in a matchup such as 'AAA vs. BBB', taken
    literally; null if neither does."""
    return F.when(F.col(matchup).contains(home), "home").when(F.col(matchup).contains(away), "away")


def opponent_code(matchup: str, n: int = 3) -> Column:
    """The last n characters."""
    return F.right(F.col(matchup), F.lit(n))


def home_flag(df: DataFrame, game: str, matchup: str, order: Sequence[str], name: str = "home") -> DataFrame:
    """The rows of games that have exactly two, plus which of them is at home: the first
    in order if its matchup says so, else the second."""
    w = Window.partitionBy(game)
    first = F.first(F.coalesce(side(matchup) == "home", F.lit(False))).over(w.orderBy(*order))
    return (df.withColumns({"_n": F.count(F.lit(1)).over(w), "_k": F.row_number().over(w.orderBy(*order)), "_first": first}).where("_n = 2")
            .withColumn(name, (F.col("_k") == 1) == F.col("_first")).drop("_n", "_k", "_first"))


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str], fill: float | None = None) -> DataFrame:
    """df plus columns of other, joined left on keys; other has one row for each. What
    isn't found is null, or fill."""
    out = df.join(other.select(*keys, *columns), list(keys), "left")
    return out if fill is None else out.fillna(fill, list(columns))


def with_opponent(df: DataFrame, game: str, team: str, opponent: str, columns: Sequence[str], prefix: str = "opp_") -> DataFrame:
    """df with columns of the row of the same game whose team is the opponent; rows
    without such a row are dropped."""
    other = df.select(F.col(game).alias("_g"), F.col(team).alias("_t"), *[F.col(c).alias(prefix + c) for c in columns])
    return df.join(other, (F.col(game) == F.col("_g")) & (F.col(opponent) == F.col("_t"))).drop("_g", "_t")


def pair_up(df: DataFrame, game: str, home: str, columns: Sequence[str]) -> DataFrame:
    """One row per game that has both sides: home_<c> and away_<c>.

    A conditional aggregation by game: one shuffle, not a self-join."""
    sides = [F.max(F.when(F.col(home) if side == "home" else ~F.col(home), F.struct(c))).getField(c).alias(f"{side}_{c}")
             for side in ("home", "away") for c in columns]
    seen = [F.count_if(F.col(home)).alias("_h"), F.count_if(~F.col(home)).alias("_a")]
    return df.groupBy(game).agg(*sides, *seen).where("_h = 1 and _a = 1").drop("_h", "_a")


def pair_join(df: DataFrame, game: str, home: str, columns: Sequence[str]) -> DataFrame:
    """The same as a join of home rows with away rows."""
    a = df.where(home).select(game, *[F.col(c).alias(f"home_{c}") for c in columns])
    b = df.where(~F.col(home)).select(game, *[F.col(c).alias(f"away_{c}") for c in columns])
    return a.join(b, game)


def deltas(df: DataFrame, columns: Sequence[str] | None = None, prefix: str = "delta_", starting: str = "") -> DataFrame:
    """df plus home minus away of each column; None: of every column that has both sides
    and whose name speaks of rolling or ewma, and starts so (z_: season scores only)."""
    if columns is None:
        columns = [c[5:] for c in df.columns if c.startswith(f"home_{starting}") and f"away_{c[5:]}" in df.columns and ("_rolling_" in c or "_ewma_" in c)]
    return df.withColumns({f"{prefix}{c}": F.col(f"home_{c}") - F.col(f"away_{c}") for c in columns})
