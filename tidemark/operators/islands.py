"""Populations on islands as a table: who migrates where, whom they replace, and the joint ranking at the end.

A population has the columns island, dna and fitness (the sum of the objectives).  Ranks
are windows over an island; migrants meet the places they take by equality on (island, place).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.search import crowding, skyline

TOPOLOGIES = ("ring", "random", "all_to_all")


def migrants(population: DataFrame, size: int) -> DataFrame:
    """(source, place, dna, fitness): the ``size`` fittest of each island, from place 1; ties by dna."""
    best = Window.partitionBy("island").orderBy(F.desc("fitness"), "dna")
    ranked = population.withColumn("place", F.row_number().over(best)).where(F.col("place") <= size)
    return ranked.select(F.col("island").alias("source"), "place", "dna", "fitness")


def random_target(source: Column, islands: int, generation: int, seed: int) -> Column:
    """Another island, by a linear congruence of the source, the generation and the seed."""
    mixed = F.pmod(source * 2654435761 + generation * 40503 + seed * 69069 + 12345, F.lit(1 << 32))
    return F.pmod(source + 1 + F.pmod(F.floor(mixed / 65536), F.lit(islands - 1)), F.lit(islands))


def sent(moving: DataFrame, islands: int, topology: str, generation: int = 0, seed: int = 0) -> DataFrame:
    """Migrants with their ``target`` and the place they come for there; the fittest come first.

    On the ring an island sends to the next, at random to one other.  All to all, migrants of all islands in their
    order are dealt out in equal shares; what is left over stays.  An island alone keeps its own.
    """
    if topology not in TOPOLOGIES:
        raise ValueError(f"no topology {topology}")
    if topology == "all_to_all":
        counts = moving.groupBy("source").agg(F.count("*").alias("_n"))
        w = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)  # a row for each island
        before = counts.select("source", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
        share = F.floor(F.col("_total") / islands)
        at = F.col("_before") + F.col("place") - 1
        dealt = moving.join(F.broadcast(before), "source").where((share > 0) & (at < share * islands))
        return dealt.select("source", F.floor(at / share).cast("long").alias("target"), (at % share + 1).cast("int").alias("place"), "dna", "fitness")
    if islands < 2:
        return moving.withColumn("target", F.col("source")).where("false").select("source", "target", "place", "dna", "fitness")
    target = F.pmod(F.col("source") + 1, F.lit(islands)) if topology == "ring" else random_target(F.col("source"), islands, generation, seed)
    return moving.select("source", target.cast("long").alias("target"), "place", "dna", "fitness")


def received(population: DataFrame, arriving: DataFrame) -> DataFrame:
    """The population after migrants have taken the places of the least fit; ``came_from`` says whence.

    The k-th migrant takes the k-th worst place.  Of several who come for one place the one from the lowest island takes it.
    """
    worst = Window.partitionBy("island").orderBy("fitness", "dna")
    placed = population.withColumn("_place", F.row_number().over(worst))
    first = arriving.groupBy("target", "place").agg(F.min(F.struct("source", "dna", "fitness")).alias("_m"))
    joined = placed.join(first, (F.col("island") == F.col("target")) & (F.col("_place") == F.col("place")), "left")
    return joined.select("island", F.coalesce("_m.dna", "dna").alias("dna"), F.coalesce("_m.fitness", "fitness").alias("fitness"), F.col("_m.source").alias("came_from"))


def synchronized(people: DataFrame, objectives: Sequence[str], size: int) -> DataFrame:
    """Of all islands' distinct individuals the ``size`` best with ``front`` and ``crowding``: front by front, the last by crowding.

    ``people``: dna and the objectives, to be maximised.  Ends of a front (crowding null) come before its others, ties go by dna.
    Fronts are peeled off one after another, as many as it takes; those found, little more than ``size`` rows, are held as a
    local table between the rounds, so the plan of a round doesn't hold those before.
    """
    spark = people.sparkSession
    pool = people.dropna(subset=list(objectives)).select("dna", *objectives).dropDuplicates(["dna"]).persist()
    out = pool.withColumn("front", F.lit(0)).where("false")
    n = front = 0
    while n < size:
        front += 1
        found = skyline(pool.join(F.broadcast(out.select("dna")), "dna", "left_anti"), objectives)
        found = found.select("dna", *objectives, F.lit(front).alias("front")).unionByName(out).toArrow()
        if found.num_rows == n:
            break
        n, out = found.num_rows, spark.createDataFrame(found, "dna string, " + ", ".join(f"`{o}` double" for o in objectives) + ", front int")
    pool.unpersist()
    ranked = crowding(out, "front", objectives, "dna")
    place = F.row_number().over(Window.orderBy("front", F.col("crowding").desc_nulls_first(), "dna"))  # little more than ``size`` rows
    return ranked.withColumn("_k", place).where(F.col("_k") <= size).drop("_k")
