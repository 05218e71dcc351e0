"""Shuffles of row numbers as formulas, and sums over many shuffles without moving a row for any of them."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHUFFLE_BLOCK = 250_000  # rows of a block of coefficients or of values
SHUFFLE_CELLS = 2_000_000  # row numbers shuffled at a time
SHUFFLE_ROUNDS, SHUFFLE_PRIME = 10, 2**31 - 1  # with ten, images of two numbers look independent even for a dozen numbers


def shuffle_sides(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square that holds n numbers."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, math.ceil(n / a))


def shuffle_keys(reps: np.ndarray, seed: int) -> np.ndarray:
    """[repetition, round, 2] factors and summands from an md5 each, which any SQL engine can follow."""
    out = np.empty((len(reps), SHUFFLE_ROUNDS, 2), np.int64)
    for i, rep in enumerate(reps):
        for r in range(SHUFFLE_ROUNDS):
            digest = hashlib.md5(f"{seed}:{rep}:{r}".encode()).hexdigest()
            out[i, r] = int(digest[:7], 16) + 1, int(digest[7:14], 16)
    return out


def keyed_shuffle(numbers: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """[repetition, number] images of the numbers under one bijection of 0..n-1 per repetition.

    A Feistel network over the two coordinates in a near-square: each round adds a keyed hash of one to the other.
    Images beyond n go through it again until they fall below.
    """
    a, b = shuffle_sides(n)

    def once(v: np.ndarray, k: np.ndarray) -> np.ndarray:
        left, right = v // b, v % b
        for r in range(SHUFFLE_ROUNDS):
            factor, summand = k[:, r, 0], k[:, r, 1]
            if r % 2 == 0:
                left = (left + (right * factor + summand) % SHUFFLE_PRIME) % a
            else:
                right = (right + (left * factor + summand) % SHUFFLE_PRIME) % b
        return left * b + right

    shape = (len(keys), len(numbers))
    out = once(np.broadcast_to(numbers, shape), keys[..., None])
    while (beyond := out >= n).any():
        rows, _ = np.nonzero(beyond)
        out[beyond] = once(out[beyond], keys[rows])
    return out


def shuffle_sums(coef: DataFrame, values: DataFrame, n: int, perms: int, seed: int = 0, block: int = SHUFFLE_BLOCK) -> DataFrame:
    """(rep, s): for every repetition the sum over i of c[i] * v[shuffle(i)]; frames are (nth, c) and (nth, v), nth from 0.

    The shuffle of a repetition is a formula of the number, so no repetition moves or sorts a row: blocks of coefficients
    meet blocks of values once, and each pair gives one sum per repetition.
    """
    blocks = max(1, math.ceil(n / block))
    portions = max(1, min(perms, math.ceil(coef.sparkSession.sparkContext.defaultParallelism / blocks**2)))  # of repetitions
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    mine = F.floor(F.col("nth") / block).cast("int")
    left = coef.select("nth", "c", mine.alias("a")).withColumn("b", every(blocks)).withColumn("p", every(portions))
    right = values.select("nth", "v", mine.alias("b")).withColumn("a", every(blocks)).withColumn("p", every(portions))

    def sums(keys: tuple, cs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        _, b, p = (int(k) for k in keys)
        reps = np.arange(1 + p, perms + 1, portions)
        out = np.zeros(len(reps))
        at = np.zeros(block)
        at[vs["nth"].to_numpy() - b * block] = vs["v"].to_numpy()
        numbers, c = cs["nth"].to_numpy(), cs["c"].to_numpy()
        step = max(1, SHUFFLE_CELLS // max(1, len(numbers)))
        for first in range(0, len(reps) if len(numbers) else 0, step):
            part = reps[first : first + step]
            there = keyed_shuffle(numbers, n, shuffle_keys(part, seed)) - b * block
            inside = (there >= 0) & (there < block)
            out[first : first + step] = np.where(inside, at[np.where(inside, there, 0)], 0.0) @ c
        return pd.DataFrame({"rep": reps, "s": out})

    keys = ["a", "b", "p"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(sums, "rep long, s double")
    return met.groupBy("rep").agg(F.sum("s").alias("s"))
