"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.llm.shared import free_name, written

#: Rows of a hot source are dealt to so many parts where the table of rates is too large to be sent along.
SALTS = 32
#: A rate is drawn in parts of up to so much: a sum of Poisson variables is one. Copies of a part are numbered in as many.
PART_RATE = 16.0
PART_COPIES = 128
#: Parts of one document that one task draws.
PARTS_AT_ONCE = 64


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) out of 52 bits of an MD5 hash of the seed and the keys."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, up to where 1 is reached in double precision.

    Summed from logarithms, so large rates don't underflow.
    """
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int"))
    start = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate / k)
        return F.struct(log_p.alias("log_p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(log_p))).alias("cdf"))

    return F.aggregate(steps, start, step, lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, source: str = "source", weights: dict[str | None, float] | None = None,
                 total: int | None = None) -> DataFrame:
    """Per source: rows there are and the mean number of copies of each that meets the target.

    weights: target share of each source (they are scaled to add up to 1); a source
    that isn't named gets none. None: every source that occurs gets the same share.
    total: rows wanted; None: as many as there are.
    """
    counts = written(docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n")))
    facts = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("sources")).first()
    wanted = facts["rows"] if total is None else total
    if weights is None:
        share = F.lit(1.0 / max(facts["sources"], 1))
    else:
        whole = sum(weights.values())
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(w / whole)).otherwise(share)
    return counts.withColumn("rate", F.lit(float(wanted or 0)) * share / F.col("n"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: str = "mix",
                source: str = "source", doc_id: str = "doc_id", copy: str = "copy") -> DataFrame:
    """The documents replicated so that each source has its target share, in a global random order.

    A document of a source with the mean repetition rate r gets Poisson(r) copies:
    the number is the inverse of that distribution at a hash of seed and doc_id, so a
    rerun or a lost executor gives the same copies. `copy` numbers them from 1. Rows
    are then dealt to tasks and sorted there by a hash of (seed, doc_id, copy).

    A rate above 16 is drawn in equal parts of at most 16, each by a hash of its own; copies of part k are numbered from
    128 * (k - 1) + 1. The parts of a document with very many are dealt to tasks before its copies are made.

    A null source is a source of its own. Rows that share a doc_id (or have none)
    share the number of copies. Empty or null texts are rows like others; an empty
    table stays empty. All columns are kept; while one is named as `copy` underscores are put before it.

    Counting combines map-side, so a hot source is a row per task. The table of
    rates is written first: Spark sends it along if its true size is below the
    broadcast threshold, else it joins by (source, salt).
    """
    taken = docs.columns
    copy = free_name(taken, copy)
    name, salt, cdf, parts, group, part, n, key = (free_name(taken, x) for x in (
        "mix_source", "mix_salt", "mix_cdf", "mix_parts", "mix_group", "mix_part", "mix_n", "mix_key"))
    number = F.ceil(F.col("rate") / PART_RATE).cast("long")
    rates = source_rates(docs, source, weights, total).where("rate > 0").select(
        F.col("source").alias(name), number.alias(parts), poisson_cdf(F.col("rate") / number).alias(cdf),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt + "_r"))
    rates = written(rates)
    salted = docs.withColumn(salt, F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(SALTS)).cast("int"))
    joined = salted.join(rates, F.col(source).eqNullSafe(F.col(name)) & (F.col(salt) == F.col(salt + "_r")))
    few = joined.where(F.col(parts) <= PARTS_AT_ONCE).withColumn(group, F.lit(0).cast("long"))
    if rates.where(F.col(parts) > PARTS_AT_ONCE).isEmpty():
        grouped = few
    else:
        groups = F.sequence(F.lit(0).cast("long"), F.floor((F.col(parts) - 1) / PARTS_AT_ONCE))
        many = joined.where(F.col(parts) > PARTS_AT_ONCE).withColumn(group, F.explode(groups))
        grouped = few.unionByName(many.repartition(F.xxhash64(doc_id, group)))
    low = F.col(group) * PARTS_AT_ONCE + 1
    drawn = grouped.withColumn(part, F.explode(F.sequence(low, F.least(F.col(parts), low + (PARTS_AT_ONCE - 1)))))
    u = F.when(F.col(part) == 1, uniform(seed, F.col(doc_id))).otherwise(uniform(seed, F.col(doc_id), F.col(part)))
    counted = drawn.withColumn(key, u).withColumn(n, F.size(F.filter(F.col(cdf), lambda c: c <= F.col(key)))).where(F.col(n) > 0)
    base = ((F.col(part) - 1) * PART_COPIES).cast("int")
    copies = counted.select(*taken, F.explode(F.sequence(base + 1, base + F.col(n))).alias(copy))
    order = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(copy))
    return copies.withColumn(key, order).repartition(F.col(key)).sortWithinPartitions(key).drop(key)
