"""Players' profiles: what a player did per minute, averaged over earlier days, and its
principal components as a small vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from . import ewma, models, windows

#: The counts that profiles take per minute.
COUNTS = ("pts", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", "ast", "stl", "blk", "tov", "pf")
RATIOS = ("true_shooting", "effective", "turnovers", "assists_per_turnover", "usage", "game_score", "fantasy", "impact")
COLUMNS = tuple([f"{c}_rate" for c in COUNTS]) + RATIOS


def stats() -> dict[str, Column]:
    """The 22 numbers of a player's day, nulls as 0, out of its counts and minutes."""
    rates = {f"{c}_rate": sc.per_minute(c, "minutes") for c in COUNTS}
    ratios = dict(zip(RATIOS, (sc.true_shooting("pts", "fga", "fta"), sc.effective_goals("fgm", "fg3m", "fga"), sc.turnover_rate("tov", "fga", "fta"), sc.ratio("ast", "tov"),
                               sc.usage("fga", "fta", "tov", "minutes"), sc.linear_score(sc.GAME_SCORE, 0.0), sc.linear_score(sc.FANTASY, 0.0), sc.ratio(sc.linear_score(sc.IMPACT, 0.0), "minutes")), strict=True))
    return rates | {c: F.coalesce(x, F.lit(0.0)) for c, x in ratios.items()}


def profiles(df: DataFrame, player: str, date: str, ties: Sequence[str], halflife: float = 20, keep: Sequence[str] = ()) -> DataFrame:
    """player, date and the profile as of the day before, for each of a player's days but
    the first, and the columns in keep. Of several rows of a day the last by ties counts.

    The counts become numbers only after the last sort. df dealt by player isn't shuffled."""
    last = windows.keep_last(df, [player, date], ties)
    before = ewma.ewma(last, {f"_{c}": x.cast("double") for c, x in stats().items()}, [player], [date], halflife=halflife, adjust=True)
    return before.select(player, date, *[F.col(f"_{c}").alias(c) for c in COLUMNS], *keep).dropna(subset=list(COLUMNS))


def embed(df: DataFrame, train: Column, k: int = 4) -> tuple[DataFrame, list[float]]:
    """df plus embed_1..embed_k, components of the profile scaled and fitted on the rows of
    train, and the variance that each explains there."""
    return embed_by(df, df.where(train), k)


def embed_by(df: DataFrame, train: DataFrame, k: int = 4) -> tuple[DataFrame, list[float]]:
    """embed by the profiles of another table."""
    out, explained = models.pca_by(models.assemble(df, COLUMNS, "_profile"), models.assemble(train, COLUMNS, "_profile"), "_profile", k)
    return out.drop("_profile").withColumnsRenamed({f"pca_{i}": f"embed_{i}" for i in range(1, k + 1)}), explained
