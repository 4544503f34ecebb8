"""Interaction weight, coins, influence score."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import Weights


def weight(w: Weights) -> Column:
    return F.lit(w.alpha) * F.col("likes") + F.lit(w.beta) * F.col("shares") + F.lit(w.gamma) * F.col("comments")


#: Fixed values of the coins: a prime below 2**31, a multiplier for each part of an edge's key, one for the trial and one for each mix.
PRIME, FACTORS, TRIAL, MIX = 2147483647, {"part": 1540483477, "src": 1566083941, "dest": 1664525, "likes": 22695477, "shares": 1103515245, "comments": 134775813, "occ": 69069}, 16807, 48271


def _mixed(rows: DataFrame, name: str, x: Column) -> DataFrame:
    """rows with name = MIX x to the fifth, modulo PRIME: another number for each x."""
    rows = rows.withColumn(name, x % PRIME).withColumn("_two", F.col(name) * F.col(name) % PRIME)
    return rows.withColumn("_four", F.col("_two") * F.col("_two") % PRIME).withColumn(name, F.col("_four") * F.col(name) % PRIME * MIX % PRIME).drop("_two", "_four")


def coins(edges: DataFrame, trials: int, seed: int) -> DataFrame:
    """edges (part, KEY, occ) once for each trial, with a coin u in [0, 1): whole-number arithmetic on seed, part, key and trial, so a rerun throws the same."""
    key = F.lit(seed).cast("bigint")
    for c, factor in FACTORS.items():
        key = key + F.pmod(F.col(c).cast("bigint"), F.lit(PRIME)) * factor % PRIME
    thrown = _mixed(edges, "_key", key).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    thrown = _mixed(thrown, "_u", F.col("_key") + (F.col("trial").cast("bigint") + 1) * TRIAL)
    return thrown.withColumn("u", F.col("_u") / F.lit(float(PRIME))).drop("_key", "_u")


def live_bits(edges: dict[str, np.ndarray], trials: Iterable[int], seed: int) -> np.ndarray:
    """coins by arrays: for each edge a whole number with a bit for each of up to 64 trials, set if its coin is below the edge's w."""

    def mixed(x: np.ndarray) -> np.ndarray:
        x = np.fmod(x, PRIME)
        two = np.fmod(x * x, PRIME)
        return np.fmod(np.fmod(np.fmod(two * two, PRIME) * x, PRIME) * MIX, PRIME)

    key = np.full(len(edges["w"]), seed, dtype=np.int64)
    for c, factor in FACTORS.items():
        key += np.mod(edges[c].astype(np.int64), PRIME) * factor % PRIME
    key, out = mixed(key), np.zeros(len(key), dtype=np.uint64)
    for j, t in enumerate(trials):
        out |= (mixed(key + (t + 1) * TRIAL) / float(PRIME) < edges["w"]).astype(np.uint64) << np.uint64(j)
    return out


def influence(followers: Column, sources: Column, n: Column, d: float = 0.85) -> Column:
    """(1 - d) x followers / n + d x sources; sums over a set of vertices give the set's power."""
    raw = F.lit(1 - d) * followers / n + F.lit(d) * sources
    return F.when(F.isnan(raw) | (raw < 0), 0.0).otherwise(raw)
