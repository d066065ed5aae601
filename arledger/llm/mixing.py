"""Mixing sources to target weights by Sainte-Laguë apportionment.

The budget is cut into blocks of equal size. Every source is split into shards of about
``shard_docs`` documents, and blocks go to (source, shard) units by highest quotients of
``target share / (2k - 1)``. Quotas are found by narrowing the divisor with whole-table sums,
so neither blocks nor quotients are listed. Inside a unit, documents stand in seeded order and
the first blocks of that order are taken; a quota above the unit's size takes every document
again. What rounding leaves between a source's quotas and its target, less than a block per
unit, is settled over the units in order.

Defined cases: null, empty and blank texts have size 0 and are never taken; a null source is a
source of its own, last in order; repeated rows are documents of their own; equal rows in the
seeded order are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arledger.llm.common import SPACE, SPACE_CHARS, stored, words

WEIGHTS = (3, 1, 2)
_GRID = 32


def source_targets(
    sized: DataFrame, weights: Sequence[int], share: float, most: int
) -> tuple[DataFrame, float]:
    """Per source: source_size, source_docs, target; and the budget.

    Targets are ``min(most * size, level * weight)``. The level starts at budget / weights and
    is raised by what capped sources cannot take until no further source is capped.
    """
    totals = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_docs")
    )
    # One row per source stands in this window, not one per document.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    totals = stored(totals.withColumn("weight", weight))
    row = totals.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    budget = share * float(row["n"] or 0)
    level = budget / row["w"] if row["w"] else 0.0
    capped = -1
    while True:
        over = most * F.col("source_size") <= level * F.col("weight")
        row = totals.agg(
            F.count_if(over).alias("capped"),
            F.sum(F.when(over, most * F.col("source_size"))).alias("taken"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"),
        ).first()
        if row["capped"] == capped or not row["free"]:
            break
        capped = row["capped"]
        level = (budget - (row["taken"] or 0)) / row["free"]
    target = F.least(
        (most * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight")
    )
    return totals.withColumn("target", target), budget


def _seats(votes: Column, divisor: float) -> Column:
    return F.floor(votes / F.lit(divisor) + F.lit(0.5)).cast("long")


def sainte_lague(parties: DataFrame, seats: int, key: Sequence[str]) -> DataFrame:
    """Adds ``quota``: ``seats`` seats by highest quotients of ``votes`` over odd numbers.

    Seats for a divisor d are ``floor(votes / d + 1/2)``. Each pass sums them for a grid of
    divisors, until one gives the wanted number. Equal quotients at the border go by key.
    """
    row = parties.agg(F.sum("votes").alias("v"), F.count("*").alias("n")).first()
    total, n = float(row["v"] or 0.0), row["n"]
    if seats <= 0 or total <= 0:
        return parties.withColumn("quota", F.lit(0).cast("long"))
    # Rounding moves the sum by half a seat a party at most, which brackets the divisor.
    few = 2.0 * total + 1.0 if seats - n / 2 - 1 <= 0 else total / (seats - n / 2 - 1)
    many = total / (seats + n / 2 + 1)
    for _ in range(24):
        grid = [few * (many / few) ** (i / _GRID) for i in range(_GRID + 1)]
        sums = parties.agg(
            *(F.sum(_seats(F.col("votes"), d)).alias(f"d{i}") for i, d in enumerate(grid))
        ).first()
        exact = [d for d, got in zip(grid, sums) if got == seats]
        if exact:
            return parties.withColumn("quota", _seats(F.col("votes"), exact[0]))
        at = max(i for i, got in enumerate(sums) if got < seats)
        short = seats - sums[at]
        if (grid[at], grid[at + 1]) == (few, many) or few / many < 1 + 1e-14:
            break
        few, many = grid[at], grid[at + 1]
    base = parties.withColumn("quota", _seats(F.col("votes"), few))
    tied = (
        base.where(_seats(F.col("votes"), many) > F.col("quota"))
        .orderBy(*(F.col(k).asc_nulls_last() for k in key))
        .limit(short)
        .select(*(F.col(k).alias(f"__{k}") for k in key), F.lit(1).alias("__more"))
    )
    met = F.lit(True)
    for k in key:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = base.join(tied, met, "left")
    return joined.withColumn("quota", F.col("quota") + F.coalesce("__more", F.lit(0))).select(
        *parties.columns, "quota"
    )


def _unit_words(
    units: DataFrame, budget: float, block_words: int, most: int
) -> DataFrame:
    """Words to take from each (source, shard) unit."""
    votes = F.when(
        F.col("source_size") > 0, F.col("target") * F.col("unit_size") / F.col("source_size")
    ).otherwise(0.0)
    parties = stored(units.withColumn("votes", votes))
    quotas = sainte_lague(parties, round(budget / block_words), ("source", "shard"))
    room = most * F.col("unit_size")
    quotas = quotas.withColumn("words", F.least(F.col("quota") * block_words, room))
    of_source = Window.partitionBy("source")
    so_far = of_source.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    lack = F.round("target").cast("long") - F.sum("words").over(of_source)
    spare = F.when(F.col("__lack") > 0, room - F.col("words")).otherwise(F.col("words"))
    left = F.abs("__lack") - F.coalesce(F.sum("__spare").over(so_far), F.lit(0))
    step = F.greatest(F.lit(0), F.least(F.col("__spare"), left)) * F.signum("__lack")
    return (
        quotas.withColumn("__lack", lack)
        .withColumn("__spare", spare)
        .withColumn("words", (F.col("words") + step).cast("long"))
        .select("source", "shard", "unit_size", "source_size", "target", "words")
    )


def _mixed(
    docs: DataFrame,
    carry: Sequence[str],
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    block_words: int = 64,
    shard_docs: int = 1000,
    seed: int = 17,
) -> DataFrame:
    """Column i of ``carry`` as ``__c{i}``, so that none clashes with a working name, plus
    source, size, source_size, target, passes and taken."""
    if share > most:
        raise ValueError("the budget cannot exceed what the repeats allow")
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)),
        F.col("doc_id").alias("__id"),
        F.col("source"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
    )
    if "text" not in carry:
        rows = stored(rows)
    targets, budget = source_targets(rows.select("source", "size"), weights, share, most)
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_docs") / shard_docs))
    per_source = targets.withColumnRenamed("source", "__source")
    dealt = rows.join(per_source, F.col("source").eqNullSafe(F.col("__source"))).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed), "__id", "size"), shards)
    )
    units = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("unit_size"),
        F.max("source_size").alias("source_size"),
        F.max("target").alias("target"),
    )
    quotas = stored(_unit_words(units, budget, block_words, most)).select(
        F.col("source").alias("__s"), F.col("shard").alias("__h"), "unit_size", "words"
    )
    seeded = (
        Window.partitionBy("source", "shard")
        .orderBy(F.xxhash64(F.lit(seed + 1), "__id"), "__id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = dealt.withColumn("__before", F.coalesce(F.sum("size").over(seeded), F.lit(0)))
    met = F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__h"))
    passes = F.when(F.col("unit_size") > 0, F.floor(F.col("words") / F.col("unit_size")))
    rest = F.col("words") - F.col("passes") * F.col("unit_size") - F.col("__before")
    taken = F.col("passes") * F.col("size") + F.greatest(
        F.lit(0).cast("long"), F.least(F.col("size"), rest)
    )
    return (
        placed.join(quotas, met)
        .withColumn("passes", F.coalesce(passes, F.lit(0)).cast("long"))
        .withColumn("taken", taken)
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, passes, source.

    ``passes`` full copies of a document are taken, then its first ``taken - passes * size``
    words. ``weights`` go to sources in order, repeating; ``share`` of all sizes is the budget
    and ``most`` the bound on repeats; ``block_words``, ``shard_docs`` and ``seed`` as above.
    """
    return _mixed(docs, ("doc_id",), **options).select(
        F.col("__c0").alias("doc_id"),
        "size",
        "source_size",
        "target",
        "taken",
        "passes",
        "source",
    )


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them, with the columns of ``docs``.

    One row per taken document: its text as many times as it is taken whole, then the words
    of the last, partial copy. ``n_chars`` follows the text where the column exists.
    """
    columns = docs.columns
    at = {c: F.col(f"__c{i}") for i, c in enumerate(columns)}
    bare = F.regexp_replace(F.coalesce(at["text"], F.lit("")), f"^{SPACE}+", "")
    # Cut before each word, so that the space after a word stays with it.
    pieces = F.split(bare, rf"(?<={SPACE})(?!{SPACE})")
    rest = (F.col("taken") - F.col("passes") * F.col("size")).cast("int")
    part = F.rtrim(F.array_join(F.slice(pieces, 1, rest), ""), F.lit(SPACE_CHARS))
    copies = F.array_repeat(at["text"], F.col("passes").cast("int"))
    whole = F.when(F.col("passes") > 0, F.array_join(copies, "\n"))
    out = (
        _mixed(docs, columns, **options)
        .where(F.col("taken") > 0)
        .withColumn("__text", F.concat_ws("\n", whole, F.when(rest > 0, part)))
    )
    at["text"] = F.col("__text")
    if "n_chars" in columns:
        at["n_chars"] = F.char_length("__text").cast("long")
    return out.select(*(at[c].alias(c) for c in columns))
