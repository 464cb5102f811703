"""Weights of rules at places, their shares and weighted means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shares(rows: DataFrame, place: list[str], weight: str, least: float = 1e-9) -> DataFrame:
    """Adds w, each rule's share of its place's weight; where that is `least` or less, all rules share evenly. A place has a row for each of a list of rules."""
    per = Window.partitionBy(*place)
    total = F.sum(weight).over(per)
    return rows.withColumn("w", F.when(total <= least, F.lit(1.0) / F.count("*").over(per)).otherwise(F.col(weight) / total))


def weighted_mean(rows: DataFrame, place: list[str], weight: str, value: str, over: float = 0.001) -> DataFrame:
    """(place, value): the mean over the rules whose weight is over a limit; places without any have no row."""
    return rows.where(F.col(weight) > over).groupBy(*place).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias(value))


def blended(slots: DataFrame, place: list[str], biome: str, slot_weight: str, biome_weight: str, value: str, over: float = 0.001) -> DataFrame:
    """(place, value): the slots of each biome by their weights, then the biomes by theirs; weights at or under the limit don't count."""
    per = slots.where((F.col(slot_weight) > over) & (F.col(biome_weight) > over)).groupBy(*place, biome)
    inner = per.agg((F.sum(F.col(slot_weight) * F.col(value)) / F.sum(slot_weight)).alias(value), F.max(biome_weight).alias("__b"))
    return inner.groupBy(*place).agg((F.sum(F.col("__b") * F.col(value)) / F.sum("__b")).alias(value))
