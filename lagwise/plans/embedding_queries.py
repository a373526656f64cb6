"""Queries over players' profiles and vectors, products of features, discovered differences
and the audit for leaks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagwise.functions import scalars as sc
from lagwise.operators import audit, ewma, pairs, profiles, windows
from lagwise.operators.models import scaled_by
from lagwise.sources import seasons
from lagwise.staging import dealt, shared_dir, stage

from . import views as v
from .player_queries import PLAYER, PLAYER_SQL, _linear, _ratio
from .registry import query_into, r

Q: dict = {}
SQL: dict[str, str] = {}
query = query_into(Q, SQL)
TIES = ["game", "line", "team", "minutes", "pts"]

_EARLY = "year(date) <= 1996"
_H = ewma.keep_of(halflife=20)
_STATS = {f"{c}_rate": f"CASE WHEN minutes >= 5 THEN {c} / minutes ELSE 0 END" for c in profiles.COUNTS} | dict(zip(profiles.RATIOS, (
    _ratio("pts", "2 * (fga + 0.44 * fta)"), _ratio("fgm + 0.5 * fg3m", "fga"), _ratio("tov", "fga + 0.44 * fta + tov"), _ratio("ast", "tov"),
    _ratio("fga + 0.44 * fta + tov", "minutes"), _linear(sc.GAME_SCORE), _linear(sc.FANTASY), _ratio(_linear(sc.IMPACT), "minutes")), strict=True))


def _mean_sql(c: str) -> str:
    return f"list_reduce({c}, lambda a, b: {_H!r} * a + b) * {1 - _H!r} / (1 - pow({_H!r}, len({c})))"


PROFILES = f"""{v.PLOG}, x AS (SELECT *, fg3m + stl AS fg3a FROM plog),
days AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player, date ORDER BY game DESC, line DESC, team DESC, minutes DESC, pts DESC) AS k FROM x) WHERE k = 1),
s AS (SELECT player, date, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in _STATS.items())} FROM days),
l AS (SELECT player, date, {', '.join(f'list({c}) OVER w AS {c}' for c in _STATS)} FROM s WINDOW w AS (PARTITION BY player ORDER BY date ROWS BETWEEN {ewma.reach(_H)} PRECEDING AND 1 PRECEDING)),
prof AS (SELECT player, date, {', '.join(f'{_mean_sql(c)} AS {c}' for c in _STATS)} FROM l WHERE pts_rate IS NOT NULL)"""


def _profiles(p, keep=()):
    # the given tables have no count of long attempts: made of two that they have
    return profiles.profiles(p.withColumn("fg3a", F.col("fg3m") + F.col("stl")), "player", "date", TIES, keep=keep)


@query(f"WITH {PROFILES} SELECT player, date, {', '.join(f'round({c}, 6) AS {c}' for c in _STATS)} FROM prof")
def player_profiles(spark, d):
    return _profiles(v.by_player(spark, d)).select("player", "date", *[r(c).alias(c) for c in profiles.COLUMNS])


_OWN = {"sum": F.sum, "mean": F.avg, "max": F.max, "std": F.stddev_samp}
_SQL_OF = {"sum": "sum", "mean": "avg", "max": "max", "std": "stddev_samp"}
_CHOSEN = ["pts_rate", "true_shooting", "usage", "game_score"]
_EXPECTED = [f"{f}_expected_{i}" for i in range(1, 5) for f in _OWN]
_RAW = [f"{f}_raw_{i}" for i in range(1, 5) for f in ("mean", "max")]


def _fitted_and_met(spark, d):
    """What vectors are made from: the plog of players, written once as narrow lines; the
    profiles of the years to 1996, which only need these years' rows, to fit on; and those
    of the days that a game of box needs, which need all rows."""
    lines, n = stage(v.lines(spark, d)), v.n_lines(spark, d)
    p = v.plog(spark, d, dealt(lines, ["player"], n), ["paired"])
    early = v.plog(spark, d, dealt(lines.where(_EARLY), ["player"], n))
    day = F.max("paired").over(Window.partitionBy("player", "date"))
    return p, _profiles(early), _profiles(p.withColumn("needed", day), ["needed"]).where("needed").drop("needed")


def vector_deltas(spark, d, p, vectors):
    """game, home_win and home minus away of team sums, means, greatest values and
    deviations: of the players' vectors (embed_1..4) times their minutes of late, and of the
    vectors alone. p is plog, dealt by player, whose rows of the games in box (paired) are
    all that is joined by player and day, then by game and team, and aggregated by game."""
    p = p.withColumn("mins", F.coalesce(windows.rolling_mean("minutes", 5, *PLAYER), F.lit(0.0))).where("paired")
    p = pairs.attach(p, vectors, ["player", "date"], [f"embed_{i}" for i in range(1, 5)], fill=0.0)
    sums = [f(F.col(f"embed_{i}") * F.col("mins")).alias(f"{n}_expected_{i}") for i in range(1, 5) for n, f in _OWN.items()]
    sums += [_OWN[n](f"embed_{i}").alias(f"{n}_raw_{i}") for i in range(1, 5) for n in ("mean", "max")]
    team = p.groupBy("game", "team").agg(*sums)
    own = v.box(spark, d).select("game", "team", "home", "pts").join(team, ["game", "team"], "left")
    g = pairs.deltas(pairs.pair_up(own, "game", "home", ["pts", *_EXPECTED, *_RAW]), [*_EXPECTED, *_RAW])
    return g.select("game", F.when(F.col("home_pts") > F.col("away_pts"), 1).otherwise(0).alias("home_win"), *[F.coalesce(f"delta_{c}", F.lit(0.0)).alias(f"delta_{c}") for c in [*_EXPECTED, *_RAW]])


_AGGS = [f"{_SQL_OF[f]}(embed_{i} * mins) AS {f}_expected_{i}" for i in range(1, 5) for f in _OWN] + [f"{_SQL_OF[f]}(embed_{i}) AS {f}_raw_{i}" for i in range(1, 5) for f in ("mean", "max")]


@query(f"""WITH {PROFILES}, {v.BOX}, m AS (SELECT {', '.join(f"avg({c}) FILTER (year(date) <= 1996) AS m{i}, stddev_pop({c}) FILTER (year(date) <= 1996) AS s{i}" for i, c in enumerate(_CHOSEN, 1))} FROM prof),
e AS (SELECT player, date, {', '.join(f'coalesce(({c} - m{i}) / nullif(s{i}, 0), 0) AS embed_{i}' for i, c in enumerate(_CHOSEN, 1))} FROM prof, m),
p AS (SELECT *, coalesce(avg(minutes) OVER ({PLAYER_SQL} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS mins FROM plog),
a AS (SELECT p.game, p.team, p.mins, {', '.join(f'coalesce(embed_{i}, 0) AS embed_{i}' for i in range(1, 5))} FROM p LEFT JOIN e ON p.player = e.player AND p.date = e.date),
t AS (SELECT game, team, {', '.join(_AGGS)} FROM a GROUP BY game, team)
SELECT x.game, CASE WHEN x.pts > y.pts THEN 1 ELSE 0 END AS home_win, {', '.join(f'round(coalesce(h.{c} - w.{c}, 0), 4) AS delta_{c}' for c in [*_EXPECTED, *_RAW])}
FROM box x JOIN box y ON x.game = y.game AND x.home AND NOT y.home LEFT JOIN t h ON h.game = x.game AND h.team = x.team LEFT JOIN t w ON w.game = y.game AND w.team = y.team""")
def profile_deltas(spark, d):
    """Four numbers of the profile, scaled by the years to 1996, as the players' vectors."""
    p, early, e = _fitted_and_met(spark, d)
    e = scaled_by(e, early, _CHOSEN).withColumnsRenamed({c: f"embed_{i}" for i, c in enumerate(_CHOSEN, 1)})
    out = vector_deltas(spark, d, p, e)
    return out.select("game", "home_win", *[r(c, 4).alias(c) for c in out.columns[2:]])


@query()
def embedding_deltas(spark, d):
    """The profile's four components, fitted on the years to 1996, as the players' vectors."""
    p, early, e = _fitted_and_met(spark, d)
    e, _ = profiles.embed_by(e, early)
    return vector_deltas(spark, d, p, e)


_SPANS = (3, 5, 10)


@query(f"""WITH {v.PLOG}, f AS (SELECT *, {', '.join(f"coalesce(avg(pts) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0) AS form_{n}, coalesce(list_reduce(list(minutes) OVER (w ROWS BETWEEN {ewma.reach(ewma.keep_of(span=n))} PRECEDING AND 1 PRECEDING), lambda a, x: {ewma.keep_of(span=n)!r} * a + {1 - ewma.keep_of(span=n)!r} * x), 0) AS mins_{n}" for n in _SPANS)} FROM plog WINDOW w AS ({PLAYER_SQL}))
SELECT player, game, line, team, minutes, pts, round(form_5 * mins_5, 4) AS expected_impact, {', '.join(f'round(form_{n} * mins_{n}, 4) AS importance_{n}' for n in _SPANS)} FROM f""")
def interaction_products(spark, d):
    """Form of the last games times minutes of late, by three spans."""
    p = ewma.fan_out(v.plog(spark, d), ["minutes"], *PLAYER, spans=_SPANS)
    p = p.withColumns({f"form_{n}": F.coalesce(windows.rolling_mean("pts", n, *PLAYER), F.lit(0.0)) for n in _SPANS}).fillna(0.0, [f"minutes_ewma_{n}" for n in _SPANS])
    product = {n: F.col(f"form_{n}") * F.col(f"minutes_ewma_{n}") for n in _SPANS}
    return p.select("player", "game", "line", "team", "minutes", "pts", r(product[5], 4).alias("expected_impact"), *[r(x, 4).alias(f"importance_{n}") for n, x in product.items()])


_Q3 = ewma.keep_of(span=3)


@query(f"""WITH {v.BOX}, z AS (SELECT *, coalesce((pts - avg(pts) OVER s) / nullif(stddev_samp(pts) OVER s, 0), 0) AS z_pts FROM box WINDOW s AS (PARTITION BY season)),
f AS (SELECT *, avg(z_pts) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS roll, list_reduce(list(z_pts) OVER (w ROWS BETWEEN {ewma.reach(_Q3)} PRECEDING AND 1 PRECEDING), lambda a, x: {_Q3!r} * a + {1 - _Q3!r} * x) AS e
  FROM z WINDOW w AS (PARTITION BY team ORDER BY date, game))
SELECT h.game, round(h.roll - a.roll, 6) AS delta_z_pts_rolling_8, round(h.e - a.e, 6) AS delta_z_pts_ewma_3 FROM f h JOIN f a ON h.game = a.game AND h.home AND NOT a.home""")
def discovered_deltas(spark, d):
    """Home minus away of every lagged feature of season scores, found by its name."""
    f = ewma.fan_out(windows.group_zscore(v.box(spark, d), ["season"], ["pts"]), ["z_pts"], *v.TEAM, spans=(3,))
    f = f.withColumn("pts_rolling_8", windows.rolling_mean("pts", 8, *v.TEAM))
    g = pairs.deltas(pairs.pair_up(f, "game", "home", ["pts_rolling_8", "z_pts", "z_pts_rolling_8", "z_pts_ewma_3"]), starting="z_")
    return g.select("game", *[r(c).alias(c) for c in g.columns if c.startswith("delta_")])


_AUDITED = ["form", "twice", "season_score", "own_mean"]


def _audited(df):
    """Two features that see earlier rows only and two that leak: a score by the whole
    season and a mean with the row's own outcome."""
    f = windows.group_zscore(df, ["season"], ["pts"]).withColumnRenamed("z_pts", "season_score")
    f = f.withColumn("form", windows.rolling_mean("pts", 8, *v.TEAM)).withColumn("own_mean", F.avg("pts").over(windows.by(*v.TEAM).rowsBetween(-8, 0)))
    return f.withColumn("twice", windows.rolling_mean("form", 3, *v.TEAM))


_FEATURES_SQL = """avg(pts) OVER (PARTITION BY {k} team ORDER BY date, game ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS form, avg(pts) OVER (PARTITION BY {k} team ORDER BY date, game ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS own_mean,
  coalesce((pts - avg(pts) OVER (PARTITION BY {k} season)) / nullif(stddev_samp(pts) OVER (PARTITION BY {k} season), 0), 0) AS season_score"""


@query(f"""WITH {v.BOX}, c AS (SELECT CAST(row_number() OVER (ORDER BY m, date, game) - 1 AS INTEGER) AS cut, date AS cd, game AS cg FROM (SELECT DISTINCT date, game, md5(CAST(date AS VARCHAR) || ':' || CAST(game AS VARCHAR)) AS m FROM box) ORDER BY m, date, game LIMIT 3),
b AS (SELECT cut, team, date, game, season, CASE WHEN date = cd AND game = cg THEN 0 ELSE pts END AS pts FROM box, c WHERE date < cd OR date = cd AND game <= cg),
w1 AS (SELECT team, date, game, {_FEATURES_SQL.format(k='')} FROM box), w AS (SELECT *, avg(form) OVER (PARTITION BY team ORDER BY date, game ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS twice FROM w1),
p1 AS (SELECT cut, team, date, game, {_FEATURES_SQL.format(k='cut,')} FROM b), p AS (SELECT *, avg(form) OVER (PARTITION BY cut, team ORDER BY date, game ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS twice FROM p1)
{' UNION ALL '.join(f"SELECT p.cut, '{c}' AS feature, count(*) AS n_rows, count(*) FILTER (p.{c} IS DISTINCT FROM w.{c} AND coalesce(abs(p.{c} - w.{c}) > 1e-9 * (1 + abs(w.{c})), true)) AS n_changed FROM p JOIN w USING (team, date, game) GROUP BY p.cut" for c in _AUDITED)}""")
def leak_audit(spark, d):
    """What changes when the table is cut at three moments: nothing in the lagged features."""
    box = v.box(spark, d).select("team", "date", "game", "season", "pts")
    return audit.leak_audit(box, _audited, ["team", "game"], ["date", "game"], ["pts"], _AUDITED, cuts=3)


_Q5 = ewma.keep_of(span=5)


@query(f"""WITH {v.BOX} SELECT season, game, team, round(avg(pts) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 6) AS form,
round(list_reduce(list(pts) OVER (w ROWS BETWEEN {ewma.reach(_Q5)} PRECEDING AND 1 PRECEDING), lambda a, x: {_Q5!r} * a + {1 - _Q5!r} * x), 6) AS trend FROM box WINDOW w AS (PARTITION BY team ORDER BY date, game)""")
def repeated_loads(spark, d):
    """Features of a history that was first loaded with wrong points from 1996 on, then had
    these seasons replaced; only they and later ones are made again."""
    box = v.box(spark, d).select("season", "date", "game", "team", "pts")
    raw, out = shared_dir(spark), shared_dir(spark)

    def features(df):
        return ewma.ewma(df.withColumn("form", windows.rolling_mean("pts", 8, *v.TEAM)), {"trend": "pts"}, *v.TEAM, span=5)

    def load(since=None):
        return seasons.refresh(spark, raw, out, features, "season", ["team"], ["date", "game"], ewma.reach(_Q5) + 1, since)

    seasons.replace_seasons(box.withColumn("pts", F.when(F.col("season") >= 1996, 0.0).otherwise(F.col("pts"))), raw, "season")
    load()
    changed = seasons.replace_seasons(box.where("season >= 1996"), raw, "season")
    load(min(changed, default=None))
    return spark.read.parquet(f"{out}/features").select("season", "game", "team", r("form").alias("form"), r("trend").alias("trend"))
