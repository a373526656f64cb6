"""Queries over teams' games: lagged windows, streaks, scores, pairs, ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.operators import ewma, levels, pairs, ratings, scans, windows

from . import views as v
from .registry import query_into, r

TEAM_SQL = "PARTITION BY team ORDER BY date, game"
USER_SQL = "PARTITION BY user_id ORDER BY ts, event_id"
Q: dict = {}
SQL: dict[str, str] = {}


query = query_into(Q, SQL)


def ewma_sql(value: str, over: str, q: float, n: int, source: str) -> str:
    """DuckDB: fold the rows before, the oldest first."""
    return f"list_reduce(list({value}) OVER ({over} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), lambda a, x: {q!r} * a + {1 - q!r} * x)"


@query(f"WITH {v.SERIES} SELECT user_id, event_id, round(avg(value) OVER ({USER_SQL} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 6) AS rolling_mean FROM series")
def lagged_rolling_mean(spark, d):
    return v.series(spark, d).select("user_id", "event_id", r(windows.rolling_mean("value", 8, *v.USER)).alias("rolling_mean"))


@query(f"WITH {v.SERIES} SELECT user_id, event_id, round(sum(value) OVER ({USER_SQL} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS rolling_sum FROM series")
def lagged_rolling_sum(spark, d):
    return v.series(spark, d).select("user_id", "event_id", r(windows.rolling_sum("value", 5, *v.USER)).alias("rolling_sum"))


def _span(span: int):
    q = ewma.keep_of(span=span)

    def run(spark, d):
        return ewma.ewma(v.series(spark, d), {"ewma": "value"}, *v.USER, span=span).select("user_id", "event_id", r("ewma").alias("ewma"))

    run.__name__ = f"ewma_span{span}"
    query(f"WITH {v.SERIES} SELECT user_id, event_id, round({ewma_sql('value', USER_SQL, q, ewma.reach(q), 'series')}, 6) AS ewma FROM series")(run)


for _s in (3, 5, 10):
    _span(_s)

_H = ewma.keep_of(halflife=20)


@query(f"""WITH {v.SERIES}, l AS (SELECT user_id, event_id, list(value) OVER ({USER_SQL} ROWS BETWEEN {ewma.reach(_H)} PRECEDING AND 1 PRECEDING) AS x FROM series)
SELECT user_id, event_id, round(list_reduce(x, lambda a, b: {_H!r} * a + b) * {1 - _H!r} / (1 - pow({_H!r}, len(x))), 6) AS ewma FROM l""")
def ewma_halflife20(spark, d):
    return ewma.ewma(v.series(spark, d), {"ewma": "value"}, *v.USER, halflife=20, adjust=True).select("user_id", "event_id", r("ewma").alias("ewma"))


@query(f"""WITH {v.SERIES}, n AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS x, row_number() OVER ({USER_SQL}) AS i FROM series),
l AS (SELECT user_id, event_id, i, list(struct_pack(x := x, i := i)) OVER ({USER_SQL} ROWS BETWEEN 57 PRECEDING AND 1 PRECEDING) AS rows FROM n),
f AS (SELECT user_id, event_id, i, list_filter(rows, lambda s: s.x IS NOT NULL) AS s FROM l)
SELECT user_id, event_id, round(list_sum(list_transform(s, lambda e: e.x * pow(0.5, i - 1 - e.i))) / list_sum(list_transform(s, lambda e: pow(0.5, i - 1 - e.i))), 6) AS ewma FROM f""")
def ewma_with_gaps(spark, d):
    s = v.series(spark, d).withColumn("x", F.when(F.col("event_id") % 13 != 0, F.col("value")))
    return s.select("user_id", "event_id", r(ewma.ewma_with_nulls("x", *v.USER, span=3, adjust=True)).alias("ewma"))


@query(f"""WITH {v.BOX} SELECT team, game, coalesce(CAST(date_diff('day', lag(date) OVER w, date) AS DOUBLE), 5.0) AS rest_days,
CASE WHEN date_diff('day', lag(date) OVER w, date) = 1 THEN 1 ELSE 0 END AS back_to_back FROM box WINDOW w AS ({TEAM_SQL})""")
def rest_days(spark, d):
    return v.box(spark, d).select("team", "game", windows.gap_days("date", *v.TEAM).alias("rest_days"), windows.gap_flag("date", *v.TEAM).alias("back_to_back"))


@query(f"""WITH {v.BOX} SELECT team, game, CASE WHEN date_diff('day', lag(date, 2) OVER w, date) <= 30 THEN 1 ELSE 0 END AS three_in_30,
CASE WHEN date_diff('day', lag(date, 3) OVER w, date) <= 60 THEN 1 ELSE 0 END AS four_in_60 FROM box WINDOW w AS ({TEAM_SQL})""")
def density_flags(spark, d):
    return v.box(spark, d).select("team", "game", windows.density_flag("date", *v.TEAM, rows=2, days=30).alias("three_in_30"),
                                  windows.density_flag("date", *v.TEAM, rows=3, days=60).alias("four_in_60"))


@query(f"""WITH {v.BOX}, f AS (SELECT team, game, date, CASE WHEN home THEN 0 ELSE 1 END AS away FROM box),
g AS (SELECT *, row_number() OVER ({TEAM_SQL}) - row_number() OVER (PARTITION BY team, away ORDER BY date, game) AS island FROM f)
SELECT team, game, away, CASE WHEN away = 0 THEN 0 ELSE row_number() OVER (PARTITION BY team, away, island ORDER BY date, game) END AS run_length FROM g""")
def run_length(spark, d):
    b = v.box(spark, d).select("team", "game", "date", (~F.col("home")).cast("int").alias("away"))
    return windows.run_length(b, "away", *v.TEAM).select("team", "game", "away", "run_length")


_RATIO = f"coalesce(sum(pts) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) / nullif(sum(poss) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) * 100, 100.0)"
_POSS = v.BOX + ", p AS (SELECT *, att + tov AS poss FROM box)"


def _ratio(spark, d):
    b = v.box(spark, d).withColumn("poss", F.col("att") + F.col("tov"))
    return b.withColumn("ratio", windows.ratio_of_sums("pts", "poss", 8, *v.TEAM))


@query(f"WITH {_POSS} SELECT team, game, round({_RATIO}, 4) AS ratio FROM p WINDOW w AS ({TEAM_SQL})")
def offensive_ratio(spark, d):
    return _ratio(spark, d).select("team", "game", r("ratio", 4).alias("ratio"))


_Q3 = ewma.keep_of(span=3)


@query(f"WITH {_POSS}, q AS (SELECT *, {_RATIO} AS ratio FROM p WINDOW w AS ({TEAM_SQL})) SELECT team, game, round({ewma_sql('ratio', TEAM_SQL, _Q3, ewma.reach(_Q3), 'q')}, 4) AS ratio_ewma FROM q")
def ratio_ewma(spark, d):
    """The mean of an already lagged series: it lags two games."""
    return ewma.ewma(_ratio(spark, d), {"ratio_ewma": "ratio"}, *v.TEAM, span=3).select("team", "game", r("ratio_ewma", 4).alias("ratio_ewma"))


@query(f"""WITH {v.BOX} SELECT team, game, round(coalesce((pts - avg(pts) OVER w) / nullif(stddev_samp(pts) OVER w, 0), 0), 6) AS z_pts,
round(coalesce((att - avg(att) OVER w) / nullif(stddev_samp(att) OVER w, 0), 0), 6) AS z_att FROM box WINDOW w AS (PARTITION BY season)""")
def season_zscore(spark, d):
    return windows.group_zscore(v.box(spark, d), ["season"], ["pts", "att"]).select("team", "game", r("z_pts").alias("z_pts"), r("z_att").alias("z_att"))


@query(f"""WITH {v.BOX} SELECT team, game, round(coalesce((pts - avg(pts) OVER w) / nullif(stddev_samp(pts) OVER w, 0), 0), 6) AS z
FROM box WINDOW w AS (PARTITION BY team, season ORDER BY date, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_zscore(spark, d):
    return v.box(spark, d).select("team", "game", r(windows.expanding_zscore("pts", ["team", "season"], ["date", "game"])).alias("z"))


#: Every number of a team's game, with products of pairs, to a row of ten.
WIDE = {"pts": "pts", "att": "att", "ast": "ast", "tov": "tov", "pts_att": "pts * att", "pts_ast": "pts * ast", "pts_tov": "pts * tov",
        "att_ast": "att * ast", "att_tov": "att * tov", "ast_tov": "ast * tov"}
_Z = f"""x AS (SELECT team, game, date, season, {', '.join(f'{e} AS {c}' for c, e in WIDE.items())} FROM box),
z AS (SELECT *, {', '.join(f'coalesce(({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0), 0) AS z_{c}' for c in WIDE)} FROM x WINDOW w AS (PARTITION BY season))"""


def _fan_sql() -> str:
    cols = []
    for c in (f"z_{c}" for c in WIDE):
        cols.append(f"round(avg({c}) OVER ({TEAM_SQL} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 6) AS {c}_rolling_8")
        for s in (3, 5, 10):
            q = ewma.keep_of(span=s)
            cols.append(f"round({ewma_sql(c, TEAM_SQL, q, ewma.reach(q), 'z')}, 6) AS {c}_ewma_{s}")
    return f"WITH {v.BOX}, {_Z} SELECT team, game, {', '.join(cols)} FROM z"


@query(_fan_sql())
def feature_fanout(spark, d):
    x = v.box(spark, d).select("team", "game", "date", "season", *[F.expr(e).alias(c) for c, e in WIDE.items()])
    z = windows.group_zscore(x, ["season"], list(WIDE))
    out = ewma.fan_out(z, [f"z_{c}" for c in WIDE], *v.TEAM)
    return out.select("team", "game", *[r(c).alias(c) for c in out.columns if "_rolling_" in c or "_ewma_" in c])


@query(f"WITH {v.FORM} SELECT a.team, a.game, a.opponent, round(b.form, 6) AS opp_form FROM form a JOIN form b ON a.game = b.game AND a.opponent = b.team")
def opponent_strength(spark, d):
    f = v.form(spark, d)
    return pairs.with_opponent(f, "game", "team", "opponent", ["form"]).select("team", "game", "opponent", r("opp_form").alias("opp_form"))


@query(f"""WITH {v.FORM}, s AS (SELECT a.team, a.game, a.date, coalesce(b.form, 0) AS f FROM form a JOIN form b ON a.game = b.game AND a.opponent = b.team)
SELECT team, game, round(coalesce(avg(f) OVER ({TEAM_SQL} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0), 4) AS schedule,
round(coalesce({ewma_sql('f', TEAM_SQL, _Q3, ewma.reach(_Q3), 's')}, 0), 4) AS schedule_ewma FROM s""")
def schedule_strength(spark, d):
    f = pairs.with_opponent(v.form(spark, d), "game", "team", "opponent", ["form"]).withColumn("f", F.coalesce("opp_form", F.lit(0.0)))
    f = f.withColumn("schedule", windows.rolling_mean("f", 8, *v.TEAM))
    out = ewma.ewma(f, {"schedule_ewma": "f"}, *v.TEAM, span=3)
    return out.select("team", "game", *[r(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("schedule", "schedule_ewma")])


@query(f"WITH {v.BOX} SELECT h.game, h.team AS home_team, a.team AS away_team, h.pts AS home_pts, a.pts AS away_pts FROM box h JOIN box a ON h.game = a.game AND h.home AND NOT a.home")
def pair_games(spark, d):
    return pairs.pair_up(pairs.only_pairs(v.box(spark, d), "game"), "game", "home", ["team", "pts"])


_MATCHUP = """m AS (SELECT game, team, opponent, lpad(CAST(team AS VARCHAR), 4, '0') || CASE WHEN game % 5 = 0 THEN ' - ' WHEN home THEN ' vs. ' ELSE ' @ ' END
  || lpad(CAST(opponent AS VARCHAR), 4, '0') AS matchup FROM box),
k AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY team) AS i, first_value(contains(matchup, ' vs. ')) OVER (PARTITION BY game ORDER BY team) AS f FROM m)"""


@query(f"""WITH {v.BOX}, {_MATCHUP} SELECT game, team, matchup, CASE WHEN contains(matchup, ' vs. ') THEN 'home' WHEN contains(matchup, ' @ ') THEN 'away' END AS side,
right(matchup, 3) AS opponent_code, (i = 1) = f AS home FROM k""")
def matchup_sides(spark, d):
    """Sides read from texts such as '0012 vs. 0007'; in a fifth of the games, where the
    text doesn't tell, the second row is at home."""
    code = lambda c: F.lpad(F.col(c).cast("string"), 4, "0")
    sign = F.when(F.col("game") % 5 == 0, " - ").when(F.col("home"), " vs. ").otherwise(" @ ")
    b = v.box(spark, d).select("game", "team", F.concat(code("team"), sign, code("opponent")).alias("matchup"))
    return pairs.home_flag(b, "game", "matchup", ["team"]).select("game", "team", "matchup", pairs.side("matchup").alias("side"), pairs.opponent_code("matchup").alias("opponent_code"), "home")


@query(f"WITH {v.GAMES} SELECT game, home_win, round(delta_pts, 6) AS delta_pts, round(delta_form, 6) AS delta_form FROM games WHERE delta_form IS NOT NULL")
def game_deltas(spark, d):
    return v.games(spark, d).dropna(subset=["delta_form"]).select("game", "home_win", r("delta_pts").alias("delta_pts"), r("delta_form").alias("delta_form"))


@query(f"""WITH {v.GAMES} SELECT season, count(*) AS games, round(avg(CASE WHEN (delta_form > 0) = (home_win = 1) THEN 1.0 ELSE 0.0 END), 6) AS form_won
FROM games WHERE delta_form IS NOT NULL GROUP BY season""")
def home_win_by_form(spark, d):
    g = v.games(spark, d).where("delta_form is not null")
    right = ((F.col("delta_form") > 0) == (F.col("home_win") == 1)).cast("double")
    return g.groupBy("season").agg(F.count(F.lit(1)).alias("games"), r(F.avg(right)).alias("form_won"))


_REPLAY = f"""WITH RECURSIVE {v.GAMES}, ids AS (SELECT team, row_number() OVER (ORDER BY team) AS k FROM (SELECT DISTINCT team FROM box)),
g AS (SELECT game, c_nationkey AS pool, h.k AS h, a.k AS a, home_win, row_number() OVER (PARTITION BY c_nationkey ORDER BY date, game) AS i
  FROM games JOIN customer ON host = c_custkey JOIN ids h ON h.team = home_team JOIN ids a ON a.team = away_team),
run(pool, i, game, hr, ar, rs) AS (
  SELECT DISTINCT pool, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, list_transform(range(0, (SELECT count(*) FROM ids)), lambda x: 1500.0::DOUBLE) FROM g
  UNION ALL
  SELECT r.pool, g.i, g.game, r.rs[g.h], r.rs[g.a], list_transform(r.rs, lambda x, k: CASE
    WHEN k = g.h THEN x + 20 * (g.home_win - 1 / (1 + pow(10, (r.rs[g.a] - r.rs[g.h]) / 400)))
    WHEN k = g.a THEN x - 20 * (g.home_win - 1 / (1 + pow(10, (r.rs[g.a] - r.rs[g.h]) / 400))) ELSE x END)
  FROM run r JOIN g ON g.pool = r.pool AND g.i = r.i + 1)"""


def _replayed(spark, d):
    """Games with both ratings, in the pool of the host's nation."""
    c = v.table(spark, d, "customer").select(F.col("c_custkey").alias("host"), F.col("c_nationkey").alias("pool"))
    g = v.games(spark, d).join(c, "host").select("game", "date", "pool", "home_team", "away_team", "home_win")
    return ratings.rating_replay(g, "pool", ["date", "game"], "home_team", "away_team", "home_win")


@query(_REPLAY + " SELECT game, CAST(pool AS INTEGER) AS pool, round(hr, 4) AS home_rating, round(ar, 4) AS away_rating FROM run WHERE i > 0")
def rating_replay(spark, d):
    """Ratings in the pool of the host's nation."""
    return _replayed(spark, d).select("game", "pool", r("home_rating", 4).alias("home_rating"), r("away_rating", 4).alias("away_rating"))


@query(_REPLAY + """ SELECT b.game, b.team, round(CASE WHEN b.home THEN r.hr ELSE r.ar END, 4) AS rating FROM box b LEFT JOIN (SELECT * FROM run WHERE i > 0) r ON b.game = r.game""")
def team_ratings(spark, d):
    """Each team's rating before its game, attached to its row."""
    own = ratings.by_team(_replayed(spark, d), "game", "home_team", "away_team")
    return pairs.attach(v.box(spark, d).select("game", "team"), own, ["game", "team"], ["rating"]).select("game", "team", r("rating", 4).alias("rating"))


#: Half of all events are one entity's, so that its rows are many times those of a block.
_HOT = "hot AS (SELECT CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS who, ts, event_id, value, event_id % 3 > 0 AS flag, abs(value) + 1 AS size FROM events)"
_HOT_SQL = "PARTITION BY who ORDER BY ts, event_id"


def _hot(spark, d) -> scans.Segments:
    e = v.table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(F.col("user_id")).cast("long").alias("who"), "ts", "event_id", "value",
                                           (F.col("event_id") % 3 > 0).cast("int").alias("flag"), (F.abs("value") + 1).alias("size"))
    return scans.cut(e, ["who"], ["ts", "event_id"], F.to_date("ts"), size=1_024)


@query(f"""WITH {_HOT} SELECT who, event_id, round(avg(value) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 6) AS mean_8, round(sum(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS sum_5,
round(coalesce(sum(value) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) / nullif(sum(size) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) * 100, 100.0), 6) AS ratio FROM hot WINDOW w AS ({_HOT_SQL})""")
def hot_rolling(spark, d):
    out = scans.halo(_hot(spark, d), 8, {"mean_8": scans.rolling_mean("value", 8), "sum_5": scans.rolling_sum("value", 5), "ratio": scans.ratio_of_sums("value", "size", 8)})
    return out.result().select("who", "event_id", *[r(c).alias(c) for c in ("mean_8", "sum_5", "ratio")])


@query(f"""WITH {_HOT}, l AS (SELECT who, event_id, list(value) OVER ({_HOT_SQL} ROWS BETWEEN {ewma.reach(_H)} PRECEDING AND 1 PRECEDING) AS x FROM hot),
s AS (SELECT who, event_id, {ewma_sql("value", _HOT_SQL, ewma.keep_of(span=10), ewma.reach(ewma.keep_of(span=10)), "hot")} AS y FROM hot)
SELECT who, event_id, round(y, 6) AS ewma_10, round(list_reduce(x, lambda a, b: {_H!r} * a + b) * {1 - _H!r} / (1 - pow({_H!r}, len(x))), 6) AS halflife_20 FROM l JOIN s USING (who, event_id)""")
def hot_ewma(spark, d):
    out = scans.ewma(scans.ewma(_hot(spark, d), {"ewma_10": "value"}, span=10), {"halflife_20": "value"}, halflife=20, adjust=True)
    return out.result().select("who", "event_id", r("ewma_10").alias("ewma_10"), r("halflife_20").alias("halflife_20"))


@query(f"""WITH {_HOT}, g AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY who, flag ORDER BY ts, event_id) AS island,
  CASE WHEN flag IS DISTINCT FROM lag(flag) OVER w THEN 1 ELSE 0 END AS begins FROM hot WINDOW w AS ({_HOT_SQL}))
SELECT who, event_id, sum(begins) OVER ({_HOT_SQL} ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id, CASE WHEN flag THEN row_number() OVER (PARTITION BY who, flag, island ORDER BY ts, event_id) ELSE 0 END AS run_length,
sum(value) OVER ({_HOT_SQL} ROWS UNBOUNDED PRECEDING) AS total FROM g""".replace("AS total", "AS total_").replace("sum(value) OVER", "round(sum(value) OVER").replace(" AS total_", ", 4) AS total"))
def hot_runs(spark, d):
    seg = scans.running(scans.runs(_hot(spark, d), "flag"), {"total": (F.col("value"), F.sum)})
    return seg.result().select("who", "event_id", "run_id", "run_length", r("total", 4).alias("total"))


_ONE_POOL = _REPLAY.replace("c_nationkey AS pool", "0 AS pool").replace("PARTITION BY c_nationkey ", "").replace("JOIN customer ON host = c_custkey ", "") + " SELECT game, round(hr, 4) AS home_rating, round(ar, 4) AS away_rating FROM run WHERE i > 0"
_GAME = ("game", ["date", "game"], "home_team", "away_team", "home_win")


@query(_ONE_POOL)
def rating_replay_one_pool(spark, d):
    """All games in one pool, by bands of their order."""
    out, _ = levels.replay_in_bands(v.games(spark, d), *_GAME)
    return out.select("game", r("home_rating", 4).alias("home_rating"), r("away_rating", 4).alias("away_rating"))


@query(_ONE_POOL)
def rating_replay_resumed(spark, d):
    """The same in two runs, the second from the ratings at the end of the first."""
    g = v.games(spark, d)
    first, state = levels.replay_in_bands(g.where("season <= 1998"), *_GAME)
    then, _ = levels.replay_in_bands(g.where("season > 1998"), *_GAME, state=state)
    return first.unionByName(then).select("game", r("home_rating", 4).alias("home_rating"), r("away_rating", 4).alias("away_rating"))
