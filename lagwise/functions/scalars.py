"""Scalar functions of box scores, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FREE_THROW_WEIGHT = 0.44

#: Weights of the game score.
GAME_SCORE = {"pts": 1.0, "fgm": 0.4, "fga": -0.7, "fta": -0.4, "ftm": 0.4, "oreb": 0.7, "dreb": 0.3, "stl": 1.0, "ast": 0.7, "blk": 0.7, "pf": -0.4, "tov": -1.0}
#: Weights of the fantasy score.
FANTASY = {"pts": 1.0, "fgm": 1.2, "fga": -0.7, "fta": -0.4, "ftm": 0.4, "oreb": 0.7, "dreb": 0.7, "ast": 1.5, "stl": 2.0, "blk": 2.0, "tov": -1.0}
#: Weights of the impact score, which is taken per minute.
IMPACT = {"pts": 1.0, "fgm": 1.0, "ftm": 1.0, "fga": -1.0, "fta": -1.0, "dreb": 1.0, "oreb": 0.5, "ast": 1.0, "stl": 1.0, "blk": 0.5, "pf": -1.0, "tov": -1.0}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den, default: float = 0.0) -> Column:
    """num / den; default where den is 0 or either is null."""
    return F.coalesce(F.try_divide(_c(num), _c(den)), F.lit(default))


def parse_minutes(text) -> Column:
    """'MM:SS' or 'MM' as minutes; what can't be read counts as 0."""
    parts = F.split(_c(text), ":")

    def number(i: int) -> Column:
        v = F.try_element_at(parts, F.lit(i)).try_cast("double")
        return F.coalesce(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v), F.lit(0.0))

    return number(1) + number(2) / 60


def linear_score(weights: dict[str, float], default: float | None = None) -> Column:
    """Sum of columns times weights; a default stands in for nulls."""
    out = F.lit(0.0)
    for c, w in weights.items():
        out = out + (F.col(c) if default is None else F.coalesce(F.col(c).cast("double"), F.lit(default))) * w
    return out


def possessions(fga, fta, oreb, tov) -> Column:
    return _c(fga) + FREE_THROW_WEIGHT * _c(fta) - _c(oreb) + _c(tov)


def true_shooting(pts, fga, fta) -> Column:
    return ratio(_c(pts), 2 * (_c(fga) + FREE_THROW_WEIGHT * _c(fta)))


def effective_goals(fgm, fg3m, fga) -> Column:
    return ratio(_c(fgm) + 0.5 * _c(fg3m), fga)


def turnover_rate(tov, fga, fta) -> Column:
    return ratio(_c(tov), _c(fga) + FREE_THROW_WEIGHT * _c(fta) + _c(tov))


def per_minute(stat, minutes, least: float = 5.0) -> Column:
    """stat / minutes where at least so many were played; otherwise 0."""
    return F.coalesce(F.when(_c(minutes) >= least, _c(stat) / _c(minutes)), F.lit(0.0))


def usage(fga, fta, tov, minutes) -> Column:
    """Attempts and turnovers per minute."""
    return ratio(_c(fga) + FREE_THROW_WEIGHT * _c(fta) + _c(tov), minutes)


def season_year(code) -> Column:
    """The year of a season code such as '22018'."""
    return F.substring(_c(code), 2, 4).try_cast("int")


def clip(p, eps: float = 1e-15) -> Column:
    return F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1 - eps))


def blend(ps: list, weights: list[float], clipped: bool = True) -> Column:
    out = F.lit(0.0)
    for p, w in zip(ps, weights, strict=True):
        out = out + _c(p) * w
    return clip(out) if clipped else out
