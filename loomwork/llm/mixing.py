"""Mixing sources to target weights by entropy balancing.

Of all rates r in [0, cap] that give every source its target of words, entropy
balancing takes the ones nearest to 1 (each document once). With a bound on the
rates the entropy is that of a choice between 0 and ``cap``, and the solution is
an exponential tilt by size: for a document of z words (in units of its source's
mean size) and its source's multiplier L

    odds(r / cap) = exp(L z) / (cap - 1),    so r = 1 at L = 0.

The dual is convex, one multiplier for each source, and its gradient is the
words a source takes less its target. Newton steps, held inside a bracket that
shrinks, solve all sources at once: each step is one aggregation over
(source, size, number of documents), to which the documents were reduced before.

Rates become whole copies by unbiased rounding against a hash of the document's
id. What a source is then off its target is taken back by shifting its rounding
threshold (32 shifts are tried in one pass), first for all its documents, then,
a few times, for those no larger than what is still missing, and at last by
adding the largest document that fits.

Words are counted in whole texts. All sums that decide are over integers or
fixed-point numbers, so a rerun agrees to the last copy.

Defined cases: a null text has size 0. A null source is a source of its own,
last in order. A source of no words has target 0 and takes none. Rows with
equal ids are rounded alike (``rounding`` can name more that tells them apart). Of
documents that fit a gap equally well the largest id takes the copy. Very long texts
are counted whole. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.shared import in_steps, scratch, stored, text_buffers, word_spans

#: Weights dealt to the sources in order, over and over.
WEIGHTS = (1, 2, 3)
#: No document is taken more often.
CAP = 3
#: Newton steps at most; a bracket halves in each where Newton would leave it.
STEPS = 60
#: A source is solved when its words are within this part of its target.
TOLERANCE = 1e-7
#: Units in which fractions are summed, so that the order of a sum can't matter.
_UNIT = 1 << 16
_SHIFTS = 32


def word_counts(docs: DataFrame, text_column: str, *kept: str) -> DataFrame:
    """The columns ``kept`` and ``size``: the words ``[^\\x20\\x09-\\x0D]+`` of the whole text."""

    def run(batches):
        for batch in in_steps(batches, text_column):
            _, offsets = text_buffers(batch.column(text_column))
            at = word_spans(*text_buffers(batch.column(text_column)))[2]
            size = pa.array(np.diff(at), pa.int64()) if len(offsets) > 1 else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], size], [*kept, "size"])

    held = docs.select(*kept, text_column)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields if f.name in kept] + ["size long"])
    return held.mapInArrow(run, schema)


def _in_order(sources: DataFrame) -> DataFrame:
    """Number sources by code point, null last, from 0: range partitions, then a number inside each."""
    parts = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = parts.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("i", inside).join(before.select("part", "before"), "part").select("source", "source_size", "n", (F.col("i") + F.col("before")).alias("place"))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, n, target`` from rows ``source, size``.

    Shares follow the weights; a target stops at ``cap`` times its source's
    size, and the excess goes to the others by weight until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    held = stored(_in_order(sources).withColumn("weight", weight), "mix-targets").withColumn("most", F.col("source_size") * float(cap))
    total = held.agg(F.sum("source_size")).first()[0] or 0
    # The level at which the uncapped share: it rises each time sources are capped, and ends when no more are.
    capped = -1
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("most")
        row = held.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("source_size"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], max(level, (total - cap * (row["held"] or 0)) / row["open"])
    target = F.least(F.col("most"), F.col("weight") * F.lit(level))
    return held.select("source", "source_size", "n", target.alias("target"))


def _rate(multiplier, z, cap: int):
    """The bounded tilt, without overflow."""
    return F.lit(float(cap)) / (1 + (cap - 1) * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -multiplier * z))))


def multipliers(sizes: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """``source, mean, multiplier, full`` for every source; ``full`` where all of it is taken ``cap`` times."""
    cells = stored(sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-cells")
    full = F.col("target") >= F.col("source_size") * float(cap) * (1 - 1e-12)
    state = goals.select("source", "target", "source_size", (F.col("source_size") / F.col("n")).alias("mean"), full.alias("full"))
    start = F.when(F.col("full") | (F.col("source_size") == 0), F.lit(True)).otherwise(F.lit(False))
    state = stored(state.withColumn("x", F.lit(0.0)).withColumn("lo", F.lit(-1e6)).withColumn("hi", F.lit(1e6)).withColumn("done", start), "mix-state")
    for _ in range(STEPS):
        if state.where("NOT done").isEmpty():
            break
        open_ = state.where("NOT done").select(F.col("source").alias("s"), "x", "mean")
        z = F.col("size") / F.col("mean")
        r = _rate(F.col("x"), z, cap)
        fixed = lambda c: F.sum(F.round(c * _UNIT).cast("decimal(38,0)"))
        moved = cells.join(open_, F.col("source").eqNullSafe(F.col("s")))
        sums = moved.groupBy("s").agg(fixed(F.col("docs") * F.col("size") * r).alias("g"), fixed(F.col("docs") * F.col("size") * z * r * (1 - r / cap)).alias("h"))
        sums = sums.select("s", (F.col("g").cast("double") / _UNIT).alias("g"), (F.col("h").cast("double") / _UNIT).alias("h"))
        new = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        off = F.col("g") - F.col("target")
        lo, hi = F.when(off < 0, F.col("x")).otherwise(F.col("lo")), F.when(off > 0, F.col("x")).otherwise(F.col("hi"))
        new = new.withColumn("l2", lo).withColumn("h2", hi).withColumn("step", F.col("x") - F.try_divide(off, "h"))
        # Outside the bracket: halve it, by magnitude while it is wide open.
        half = F.when((F.col("l2") <= -1e6) & (F.col("h2") >= 1e6), F.lit(0.0)).when(F.col("h2") >= 1e6, F.greatest(F.lit(1.0), F.col("l2") * 4)).when(F.col("l2") <= -1e6, F.least(F.lit(-1.0), F.col("h2") * 4)).otherwise((F.col("l2") + F.col("h2")) / 2)
        inside = (F.col("step") > F.col("l2")) & (F.col("step") < F.col("h2")) & (F.abs(F.col("step") - F.col("x")) < 4 + F.abs(F.col("x")))
        solved = F.abs(off) <= F.col("target") * TOLERANCE
        nxt = F.when(F.col("done") | solved, F.col("x")).when(inside, F.col("step")).otherwise(half)
        done = F.col("done") | F.coalesce(solved, F.lit(False)) | (nxt == F.col("x"))
        live = ~F.col("done")
        state = stored(
            new.select("source", "target", "source_size", "mean", "full", nxt.alias("x"), F.when(live, F.col("l2")).otherwise(F.col("lo")).alias("lo"), F.when(live, F.col("h2")).otherwise(F.col("hi")).alias("hi"), done.alias("done")),
            "mix-state",
        )
    return state.select("source", "target", "source_size", "mean", "full", F.col("x").alias("multiplier"))


def _gaps(taken: DataFrame) -> DataFrame:
    """``s, gap, target``: the words that each source takes too few."""
    gap = F.max("target") - F.sum(F.col("size") * F.col("copies"))
    return taken.groupBy("source").agg(gap.alias("gap"), F.max("target").alias("target")).withColumnRenamed("source", "s")


def _raise(taken: DataFrame, cap: int, passes: int, first: bool) -> DataFrame:
    """Raise the levels of the documents that fit a source's gap by the largest shift that keeps within its target.

    At ``first`` nothing is taken yet and the shift may be negative. A level's
    whole part is the number of copies. Each pass tries ``_SHIFTS`` shifts.
    """
    gaps = stored(_gaps(taken).where("gap >= 1"), "mix-gaps")
    if gaps.isEmpty():
        return taken
    fits = taken.join(gaps.withColumnRenamed("target", "goal"), F.col("source").eqNullSafe(F.col("s"))).where((F.col("size") > 0) & (F.col("copies") < cap))
    fits = stored((fits if first else fits.where("size <= gap")).select("s", "level", "size", "copies", "gap"), "mix-fits")
    at = lambda shift: F.greatest(F.lit(0), F.least(F.lit(cap), F.floor(F.col("level") + shift).cast("int")))
    low, width = (-(cap + 1.0), 2.0 * (cap + 1)) if first else (0.0, cap + 1.0)
    shift = gaps.select("s", F.lit(low).alias("shift"))
    for _ in range(passes):
        step = width / _SHIFTS
        tried = fits.join(shift.withColumnRenamed("s", "z"), F.col("s").eqNullSafe(F.col("z"))).groupBy("s", "shift")
        sums = tried.agg(F.max("gap").alias("gap"), *[F.sum(F.col("size") * (at(F.col("shift") + F.lit(k * step)) - F.col("copies"))).alias(f"w{k}") for k in range(1, _SHIFTS)])
        below = sum((F.when(F.col(f"w{k}") <= F.col("gap"), 1).otherwise(0) for k in range(1, _SHIFTS)), F.lit(0))
        shift = stored(sums.select("s", (F.col("shift") + below * F.lit(step)).alias("shift")), "mix-shift")
        width = step
    joined = taken.join(gaps.select("s", "gap").join(shift.withColumnRenamed("s", "z"), F.col("s").eqNullSafe(F.col("z"))).drop("z"), F.col("source").eqNullSafe(F.col("s")), "left")
    moved = F.col("shift").isNotNull() & (F.col("size") > 0) & (F.col("copies") < cap) & (F.lit(first) | (F.col("size") <= F.col("gap")))
    level = F.when(moved, F.col("level") + F.col("shift")).otherwise(F.col("level"))
    new = joined.withColumn("copies", F.when(moved, at(F.col("shift"))).otherwise(F.col("copies"))).withColumn("level", level)
    return stored(new.select(*taken.columns), "mix-copies")


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", weights=WEIGHTS, cap: int = CAP, rounds: int = 3, fits: int = 3, rounding: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate double, copies int`` for every row of ``docs``.

    ``rounding``: what gives a document its rounding threshold, ``doc_id`` or fields of it.
    """
    with scratch(docs.sparkSession) as kept:
        kept.append(stored(_mixed(docs, id_column, source_column, text_column, weights, cap, rounds, fits, rounding), "mix"))
    return kept[0]


def _mixed(docs: DataFrame, id_column: str, source_column: str, text_column: str, weights, cap: int, rounds: int, fits: int, rounding: tuple[str, ...]) -> DataFrame:
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), F.col(text_column).alias("text"))
    sizes = stored(word_counts(named, "text", "doc_id", "source"), "mix-sizes")
    state = multipliers(sizes, targets(sizes, weights, cap), cap)
    by = state.withColumnRenamed("source", "s")
    rated = sizes.join(by, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # The hash of the id gives each document its own rounding threshold, in [0, 1).
    u = F.pmod(F.xxhash64(F.lit("mix"), *rounding), F.lit(1 << 40)) / float(1 << 40)
    rate = F.when(F.col("full"), F.lit(float(cap))).when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(F.col("multiplier"), F.col("size") / F.col("mean"), cap))
    rated = stored(rated.select("doc_id", "source", "size", "source_size", "target", "full", rate.alias("rate"), u.alias("u")), "mix-rates")
    # First all documents share one shift of their source's threshold. What is then missing is smaller than
    # the next document that would have been taken; of the documents that still fit, a further shift takes more.
    taken = rated.withColumn("level", F.col("rate") + F.col("u")).withColumn("copies", F.when(F.col("full"), F.lit(cap)).otherwise(F.lit(0))).drop("full", "u")
    for i in range(rounds):
        taken = _raise(taken, cap, 4 if i == 0 else 3, first=i == 0)

    # What is still missing: add the largest document that fits, a few times.
    for _ in range(fits):
        gap = _gaps(taken).select("s", "gap").where("gap >= 1")
        fit = taken.where((F.col("copies") < cap) & (F.col("size") > 0)).join(gap, F.col("source").eqNullSafe(F.col("s"))).where("size <= gap")
        pick = fit.groupBy("s").agg(F.max_by(F.struct("doc_id", "size", "copies"), F.struct("size", "doc_id")).alias("pick"))
        picks = stored(pick.select("s", "pick.doc_id", "pick.size", "pick.copies"), "mix-picks")
        if picks.isEmpty():
            break
        # Of repeated rows only one takes the copy: they differ in nothing, so any number among equals will do.
        p = picks.select("s", F.col("doc_id").alias("p_id"), F.col("size").alias("p_size"), F.col("copies").alias("p_copies"))
        same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("size") == F.col("p_size")) & (F.col("copies") == F.col("p_copies"))
        marked = taken.join(p, same, "left")
        chosen = marked.where("p_size IS NOT NULL").withColumn("number", F.row_number().over(Window.partitionBy("source").orderBy(F.lit(1))))
        chosen = chosen.withColumn("copies", F.col("copies") + F.when(F.col("number") == 1, 1).otherwise(0)).select(*taken.columns)
        taken = stored(marked.where("p_size IS NULL").select(*taken.columns).unionByName(chosen), "mix-copies")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies"))  # a document without words weighs nothing and stays
    return taken.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))
