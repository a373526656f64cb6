"""Mixing sources to target weights by systematic sampling, in DataFrame
operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stage

#: A word is a run of anything but the blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: No source gives more than so many times its own size.
LIMIT = 3
#: A class of about equal sizes within a source is dealt to so many groups.
SALTS = 16
SEED = 17


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """docs plus _size, and _class and _salt, which name the group of a source's
    documents that are counted together."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    out = docs.withColumn("_size", size).withColumn("_bits", F.length(F.bin("_size")))
    # four leading bits: sizes in a class differ by an eighth at most
    out = out.withColumn("_class", F.expr("_bits * 16 + shiftright(_size, greatest(_bits - 4, 0))").cast("long"))
    salt = F.conv(F.substring(F.md5(F.col(doc_id).cast("string").cast("binary")), 1, 4), 16, 10).cast("long")
    return (out.withColumn("_salt", F.coalesce(salt, F.lit(0)) % SALTS)
            .withColumn("_null", F.col(source).isNull().cast("int"))
            .withColumn("_source", F.coalesce(F.col(source), F.lit(""))).drop("_bits"))


def source_plan(groups: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """One row per source (_null, _source): its size, target, rate and offset.

    groups: _null, _source, _total. Targets are the water level that the weights
    give: level * weight, or limit times the source's size where that is less."""
    every = Window.partitionBy()
    by_name = Window.orderBy("_null", "_source")
    by_cap = Window.orderBy("_ratio", "_null", "_source")
    ahead = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    out = groups.groupBy("_null", "_source").agg(F.sum("_total").alias("source_size"))
    turn = F.array(*map(F.lit, weights))
    out = out.withColumn("_weight", F.get(turn, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    out = out.withColumn("_cap", F.col("source_size") * limit).withColumn(
        "_ratio", F.col("_cap").cast("double") / F.col("_weight"))
    out = out.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(ahead), F.lit(0)))
                         .cast("double") / F.sum("_weight").over(rest))
    out = out.withColumn("_free", F.col("_cap") > F.col("_level") * F.col("_weight"))
    # the first source that is not capped sets the level for all behind it
    whole = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("_water", F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(whole))
    out = out.withColumn("target", F.coalesce(F.least(F.col("_cap").cast("double"), F.col("_water") * F.col("_weight")),
                                              F.col("_cap").cast("double")))
    name = F.coalesce(F.when(F.col("_null") == 0, F.concat(F.lit(f"{seed}:s"), "_source")), F.lit(f"{seed}:n"))
    shift = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.select("_null", "_source", "source_size", "target", rate.alias("_rate"), shift.alias("_shift"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """docs plus size, source_size, target, copies and taken (copies * size).

    Sources in order of code points, null last, weigh weights, repeating, and share
    the words of all documents; targets stop at limit times the source's size and
    the excess goes to the others by weight. Every document of a source expects
    target / source_size copies; their prefix sum, in order of size class, plus one
    offset for the source gives a copy for each whole number it crosses. Documents
    of about equal size stand together, so the words taken come near the target.

    A source's documents are counted in groups of a size class and a salt, so that
    a source with most of the rows is spread over tasks; only the groups' counts
    are summed along a source. Null and empty texts have size 0 and take 0 words;
    null ids share a salt; repeated rows each count; an empty table gives no rows.
    Columns of docs named like the results are replaced.
    """
    group = ["_null", "_source", "_class", "_salt"]
    results = ["size", "source_size", "target", "copies", "taken"]
    plain, names = numbered(docs)
    kept = [F.col(n).alias(c) for c, n in names.items() if c not in results]
    sized = _sized(plain, names[doc_id], names[text], names[source])
    # read twice; staged, so that words are counted once for it and once for the result
    groups = stage(sized.groupBy(*group).agg(F.count(F.lit(1)).alias("_count"), F.sum("_size").alias("_total")))
    ahead = Window.partitionBy("_null", "_source").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("_start", F.coalesce(F.sum("_count").over(ahead), F.lit(0)))
    plan = starts.join(source_plan(groups, weights, limit, seed), ["_null", "_source"]).select(
        *group, "_start", "source_size", "target", "_rate", "_shift")
    place = Window.partitionBy(*group).orderBy(names[doc_id], "_size", "_tie")
    at = F.col("_start") + F.col("_place")
    crossed = F.floor(F.col("_rate") * at + F.col("_shift")) - F.floor(F.col("_rate") * (at - 1) + F.col("_shift"))
    out = sized.withColumn("_tie", F.xxhash64(names[text])).withColumn("_place", F.row_number().over(place)).join(plan, group)
    return (out.withColumn("size", F.col("_size")).withColumn("copies", F.least(crossed, F.lit(limit)).cast("long"))
            .withColumn("taken", F.col("copies") * F.col("size")).select(*kept, *results))


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(docs: str = "documents") -> str:
    """DuckDB, for any relation with doc_id, text and source; all its columns and
    those of mix()."""
    return f"""
WITH s AS (SELECT *, CAST(source IS NULL AS INT) AS nul, coalesce(source, '') AS src,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {docs}),
k AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS cls,
             coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS BIGINT), 0) % {SALTS} AS salt FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY nul, src ORDER BY cls, salt, doc_id, size) AS place FROM k),
a AS (SELECT nul, src, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY 1, 2),
b AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY nul, src) - 1) % {len(WEIGHTS)} + 1] AS w,
             source_size * {LIMIT} AS cap FROM a),
c AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio FROM b),
d AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
      FROM c WINDOW o AS (ORDER BY ratio, nul, src)),
e AS (SELECT (SELECT lev FROM d WHERE cap > lev * w ORDER BY ratio, nul, src LIMIT 1) AS water),
f AS (SELECT nul, src, source_size, coalesce(least(CAST(cap AS DOUBLE), water * w), CAST(cap AS DOUBLE)) AS target,
             CAST('0x' || substr(md5('{SEED}:' || CASE WHEN nul = 0 THEN 's' || src ELSE 'n' END), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS sh
      FROM d, e),
g AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM f),
h AS (SELECT p.*, g.source_size, g.target,
             CAST(least(floor(rate * place + sh) - floor(rate * (place - 1) + sh), {LIMIT}) AS BIGINT) AS copies
      FROM p JOIN g USING (nul, src))
SELECT * EXCLUDE (nul, src, cls, salt, place), copies * size AS taken FROM h"""


def oracle() -> str:
    return f"SELECT doc_id, size, source_size, target, taken FROM ({mix_sql()})"
