"""Choosing feature columns by the schema; no job runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureSpec:
    """Numeric columns that start with one of prefixes, and extras, in that order, each
    once; without target, removed ones, and those that contain a text in without."""

    prefixes: tuple[str, ...]
    extras: tuple[str, ...] = ()
    target: str = "home_win"
    removed: frozenset[str] = field(default_factory=frozenset)
    without: tuple[str, ...] = ()


def numeric_columns(schema: T.StructType, excluded: Sequence[str] = ()) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.NumericType) and f.name not in excluded]


def select_features(schema: T.StructType, spec: FeatureSpec) -> list[str]:
    numeric = numeric_columns(schema)
    found = [c for c in numeric if c.startswith(spec.prefixes)] + [c for c in spec.extras if c in numeric]
    return [c for c in dict.fromkeys(found) if c != spec.target and c not in spec.removed and not any(x in c for x in spec.without)]


def drop_side_columns(df, stats: Sequence[str], sides: Sequence[str] = ("home_", "away_"), forms: Sequence[str] = ("", "z_")):
    """df without what is known only after the game: each stat, raw and scored, of each side."""
    return df.drop(*[f"{s}{f}{c}" for s in sides for f in forms for c in stats])
