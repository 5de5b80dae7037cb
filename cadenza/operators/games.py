"""Guess matching, round scores and leaderboards."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import exprs as X

LEAST_RATIO = 0.7


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; no built-in function has these values."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def contained(guess: Column, answer: Column) -> Column:
    """Equal or one within the other, after strip and lower; blanks never match."""
    g, a = F.lower(X.strip(guess)), F.lower(X.strip(answer))
    return F.coalesce((g != "") & (a != "") & (a.contains(g) | g.contains(a)), F.lit(False))


def most_alike(a: Column, b: Column) -> Column:
    """The most that gestalt_ratio can give: twice the number of characters that both have, by count, over both lengths."""
    shared = F.aggregate(
        F.array_distinct(F.regexp_extract_all(a, F.lit("(?s)."), F.lit(0))),
        F.lit(0),
        lambda n, c: n + F.least(F.length(a) - F.length(F.replace(a, c, F.lit(""))), F.length(b) - F.length(F.replace(b, c, F.lit("")))),
    )
    return F.try_divide(2.0 * shared, F.length(a) + F.length(b))


def undecided(rows: DataFrame, guess: str, answer: str) -> DataFrame:
    """The rows with `native` (a match by equality or containment) and the normalised texts __g and __a of those that only
    gestalt_ratio can decide: neither matched natively nor ruled out by most_alike()."""
    native = rows.withColumn("native", contained(F.col(guess), F.col(answer)))
    g, a = F.lower(X.strip(F.col(guess))), F.lower(X.strip(F.col(answer)))
    open_ = ~F.col("native") & F.coalesce(most_alike(g, a) >= LEAST_RATIO - 1e-9, F.lit(False))
    return native.withColumn("__g", F.when(open_, g)).withColumn("__a", F.when(open_, a))


def matched(rows: DataFrame, guess: str, answer: str) -> DataFrame:
    """The rows with `correct`: native tests decide most rows either way, only the rest is compared in Python."""
    found = undecided(rows, guess, answer)
    return found.withColumn("correct", F.col("native") | (gestalt_ratio(F.col("__g"), F.col("__a")) >= LEAST_RATIO)).drop("native", "__g", "__a")


def points(song: Column, artist: Column, trivia: Column) -> Column:
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return (flag(song, 100) + flag(artist, 50) + flag(trivia, 50)).cast("bigint")


def scores(guesses: DataFrame) -> DataFrame:
    """(game, player, score): the sum of a player's points."""
    return guesses.groupBy("game", "player").agg(F.sum(points(F.col("song"), F.col("artist"), F.col("trivia"))).alias("score"))


def leaderboard(guesses: DataFrame, players: DataFrame) -> DataFrame:
    """(user, score, games, songs, artists, trivia) over the party games of registered players."""
    rows = guesses.join(players.filter("user is not null and party").select("game", "player", "user"), ["game", "player"])
    return rows.groupBy("user").agg(
        F.sum(points(F.col("song"), F.col("artist"), F.col("trivia"))).alias("score"),
        F.countDistinct("game").alias("games"),
        *[F.count_if(c).alias(n) for c, n in (("song", "songs"), ("artist", "artists"), ("trivia", "trivia"))],
    )
