"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a shuffled order, from the first again after the
last. A schedule of slots is drawn from the golden-ratio sequence: slot i
belongs to the source in whose share of the cumulative targets the fraction of
(i + 1/2) times the golden ratio falls. A source's slots, ranked, take its turns: its
target, to the word, cut into as many equal blocks as it has slots. A source with fewer
than `LEAST_TURNS` slots takes its target in that many smaller blocks instead, spread
evenly over the schedule, whose slots then hold a block of it besides their own. Any
stretch of the schedule then holds the sources in nearly their target shares.

Sources are rows of a table, however many they are; the driver gets sums over them, and
the sources with so many slots that they are drawn one by one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written
from .prefix import running_sums

#: Slots of the schedule: a constant, so that the schedule's size is bounded.
SLOTS = 1 << 16
GOLDEN = (5**0.5 - 1) / 2
#: Blocks of a source at least, if its target has as many words.
LEAST_TURNS = 64
#: Sources of fewer slots than this on average have not `LEAST_TURNS` of them: golden-ratio points are spread too evenly.
FEW = 48
ADDED = ("_size", "_source_size", "_target", "_taken", "_slots")


def source_goals(found: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """found (_name, _n) with _id, its place by code points, null last, _target and _words, the target in whole words.

    Targets are shares of share * sum(_n) by weight, none above cap * _n, the excess reshared
    by weight: every source below its cap gets the same number of words for a weight. That
    number is raised until no further source is at its cap.
    """
    ranked = running_sums(found.withColumn("_one", F.lit(1).cast("long")), [F.col("_name").isNull(), F.col("_name")], "_one")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = written(ranked.select("_name", "_n", F.col("_rank").alias("_id"), weight.alias("_weight")), "weighed")
    sums = table.agg(F.sum("_n"), F.sum("_weight")).first()
    total, capped = share * (sums[0] or 0), 0
    each = total / (sums[1] or 1)
    while True:
        full = F.col("_n") * cap < F.col("_weight") * each
        some = table.agg(F.count_if(full), F.sum(F.when(full, F.col("_n") * cap)), F.sum(F.when(~full, F.col("_weight")))).first()
        if some[0] == capped:
            break
        capped, each = some[0], (total - some[1]) / some[2] if some[2] else math.inf
    most = F.col("_n") * cap
    target = F.when(most < F.col("_weight") * each, most).otherwise(F.col("_weight") * each).cast("double")
    out = table.withColumn("_target", target).withColumn("_words", F.least(F.rint("_target").cast("long"), F.floor(most).cast("long")))
    return written(out.drop("_weight"), "goals")


def schedule(goals: DataFrame, slots: int) -> tuple[DataFrame, DataFrame, int]:
    """The goals with _turns and, for sources whose slots are not drawn one by one, _offset; the drawn slots (_of, _nth, _slot); and how many slots there are."""
    spark = goals.sparkSession
    grand = goals.agg(F.sum("_words")).first()[0] or 0
    used = grand // max(1, grand // slots)
    many = running_sums(goals.select("_id", "_words"), [F.col("_id")], "_words").where(F.col("_words") * F.lit(used / max(grand, 1)) >= FEW)
    many = sorted((r._start, r._words, r._id) for r in many.collect())  # at most used / FEW of them
    starts, sizes = (np.array([r[i] for r in many], np.float64) for i in (0, 1))
    point = (np.arange(used) + 0.5) * GOLDEN % 1 * grand
    at = np.searchsorted(starts, point, side="right") - 1
    met = np.flatnonzero((at >= 0) & (point < starts[at] + sizes[at])) if many else np.zeros(0, np.int64)
    drawn = np.bincount(at[met], minlength=len(many)) if many else np.zeros(0, np.int64)
    met = met[np.argsort(at[met], kind="stable")]
    nth = np.arange(len(met)) - np.repeat(np.cumsum(drawn) - drawn, drawn)
    plan = [(many[a][2], n, slot) for a, n, slot in zip(at[met].tolist(), nth.tolist(), met.tolist(), strict=True) if drawn[a] >= LEAST_TURNS]
    plan = written(spark.createDataFrame(plan, "_of long, _nth long, _slot long"), "schedule", files=1)
    dense = plan.groupBy(F.col("_of").alias("_dense")).agg(F.count("*").alias("_drawn"))
    out = goals.join(F.broadcast(dense), F.col("_id") == F.col("_dense"), "left").select(
        "_name", "_id", F.col("_n").alias("_source_size"), "_target", "_words", F.coalesce("_drawn", F.least("_words", F.lit(LEAST_TURNS).cast("long"))).alias("_turns"),
        F.when(F.col("_drawn").isNull(), (F.col("_id") + 1) * GOLDEN % 1).alias("_offset"),
    )
    return written(out, "targets"), plan, used


def word_count(col) -> object:
    """Number of runs of anything but the six ASCII white-space characters; null: 0."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, slots: int = SLOTS, carry: list[str] | None = None) -> DataFrame:
    """docs with _size, _source_size, _target, _taken, _slots added; other columns as they are, or only those of `carry`, doc_id and source among them.

    docs needs doc_id, text and source. Sources, in order of code points and null
    last, weigh as `weights` says, repeating. _taken is how many of the row's words the
    mix takes, repeats counted; over a source they sum up to its target, rounded. _slots are
    the slots in which the row's first word is scheduled: where the mix emits the whole row. The same rows give the same mix. Rows without words
    take part with size 0 (_slots as for their place); repeated rows are rows of their
    own, in either order; an empty table gives an empty result. Added names get further
    underscores where docs has them already.
    """
    kept = carry or docs.columns
    names = fresh(docs, *(f"_c{i}" for i in range(len(kept))))
    of = dict(zip(kept, names, strict=True))
    crc = F.crc32(F.coalesce(docs["text"].cast("binary"), F.lit(b"")))
    own = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in of.items()), crc.alias("_text"), docs["text"].alias("_body"))
    count = word_count(F.col("_body"))
    if carry:  # texts are measured once; the measures are read again for the sums, the ranges and the rows
        own = written(own.withColumn("_size", count).drop("_body"), "measured")
    sized = own if carry else own.withColumn("_size", count)
    found = written(sized.groupBy(F.col(of["source"]).alias("_name")).agg(F.sum("_size").alias("_n")), "sources")
    goals = source_goals(found, weights, share, cap)
    sources, plan, used = schedule(goals, slots)

    # Sources are broadcast if Spark finds their table small; the schedule has at most 2 * SLOTS rows.
    own = own if carry else own.drop("_body")
    joined = own.join(sources, F.col(of["source"]).eqNullSafe(F.col("_name"))).drop("_name")
    order = [F.xxhash64(F.col(of["doc_id"]), F.lit(seed)), F.col(of["doc_id"]), F.col("_text")]
    out = running_sums(joined, order, "_size", "_id", None if carry else word_count(F.col(of["text"])))
    full = F.expr("_words div greatest(_source_size, 1)")
    rest = F.expr("_words % greatest(_source_size, 1)")
    part = F.least(F.col("_start") + F.col("_size"), rest) - F.least(F.col("_start"), rest)
    out = out.withColumn("_taken", full * F.col("_size") + part)
    passes = math.ceil(cap)
    for i in range(passes):
        # Rows without words at a source's end are placed with its last word.
        first = f"{i} * _source_size + least(_start, greatest(_source_size - 1, 0))"
        out = out.withColumn(f"_turn{i}", F.expr(f"CASE WHEN {first} < _words THEN ({first}) * _turns div greatest(_words, 1) END"))
        one = plan.select(F.col("_of").alias(f"_of{i}"), F.col("_nth").alias(f"_nth{i}"), F.col("_slot").alias(f"_slot{i}"))
        out = out.join(F.broadcast(one), (F.col("_id") == F.col(f"_of{i}")) & (F.col(f"_turn{i}") == F.col(f"_nth{i}")), "left")
        spread = F.least(F.floor((F.col(f"_turn{i}") + F.col("_offset")) / F.col("_turns") * used), F.lit(max(used - 1, 0)))
        out = out.withColumn(f"_slot{i}", F.when(F.col("_offset").isNull(), F.col(f"_slot{i}")).when(F.col(f"_turn{i}").isNotNull(), spread))
    out = out.withColumn("_slots", F.array_compact(F.array(*(F.col(f"_slot{i}") for i in range(passes))).cast("array<long>")))
    return out.select(*(F.col(n).alias(c) for c, n in of.items()), *(F.col(x).alias(n) for n, x in zip(fresh(docs, *ADDED), ADDED, strict=True)))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, each once for every slot in which its first word is scheduled, columns as in docs."""
    out, slots = mix(docs, **options), fresh(docs, *ADDED)[-1]
    return out.withColumn(slots, F.explode(slots)).select(*(F.col(f"`{c}`") for c in docs.columns))
