"""Bloom filters as tables of set positions."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.strings import hash60

#: Bits of a word of the filter's storage.
WORD_BITS = 31


@dataclass(frozen=True)
class Bloom:
    """A filter for about ``n`` items with a share ``p`` of false positives."""

    n: int = 10_000
    p: float = 0.01
    seed: int = 0

    @property
    def bits(self) -> int:
        return int(2 * self.n * math.log(1 / self.p) + 0.5)

    @property
    def hashes(self) -> int:
        return int(1.5 * math.log(1 / self.p) + 0.5)

    @property
    def words(self) -> int:
        return round(self.bits / WORD_BITS + 1)

    @property
    def seeds(self) -> list[int]:
        draw = random.Random(self.seed)
        return [draw.getrandbits(31) for _ in range(self.hashes)]

    def positions(self, item: Column) -> Column:
        """The places of an item, one for each hash, repeats included."""
        h = hash60(item)
        return F.array(*[F.pmod(h.bitwiseXOR(F.lit(s).cast("long")), F.lit(self.bits).cast("long")) for s in self.seeds])

    def build(self, items: DataFrame, item: str = "item") -> DataFrame:
        """``position``: the places that are set; at most ``bits`` rows, whatever the number of items."""
        return items.select(F.explode(self.positions(F.col(item))).alias("position")).distinct()

    def words_of(self, built: DataFrame) -> DataFrame:
        """``word, value``: the set places packed into words of 31 bits."""
        place = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("position") % WORD_BITS).cast("int"))
        return built.groupBy(F.floor(F.col("position") / WORD_BITS).alias("word")).agg(F.bit_or(place).alias("value"))

    def contains(self, items: DataFrame, built: DataFrame, item: str = "item") -> DataFrame:
        """The rows of ``items`` that may have been inserted; rows count one by one, equal ones too.

        The filter is probed once for each distinct item, and rows join the
        answer, so a frequent item is one probe.
        """
        probes = items.select(F.col(item).alias("_item")).distinct().select("_item", F.explode(self.positions(F.col("_item"))).alias("position"))
        found = probes.join(built, "position", "left_semi").groupBy("_item").agg(F.count(F.lit(1)).alias("_hits"))
        held = found.where(F.col("_hits") == self.hashes).select("_item")
        return items.join(held, F.col(item) == F.col("_item"), "left_semi")

    def density(self, built: DataFrame) -> DataFrame:
        """One row ``density``: set bits over the bits that the words hold."""
        return built.agg((F.count(F.lit(1)) / F.lit(float(WORD_BITS * self.words))).alias("density"))

    def report(self, train: DataFrame, probe: DataFrame, item: str = "item") -> DataFrame:
        """One row: sizes, density, lines on both sides, lines that may overlap, false positives to expect."""
        built = self.build(train, item)
        counted = train.agg(F.count(F.lit(1)).alias("lines1")).crossJoin(probe.agg(F.count(F.lit(1)).alias("lines2")))
        overlap = self.contains(probe, built, item).agg(F.count(F.lit(1)).alias("overlap"))
        row = counted.crossJoin(overlap).crossJoin(self.density(built))
        return row.select(
            F.lit(self.bits).cast("long").alias("bits"),
            F.lit(self.bits / 8 / 1024).alias("kb"),
            F.lit(self.hashes).alias("hashes"),
            "density",
            "lines1",
            "lines2",
            "overlap",
            F.round(F.col("lines2") * F.lit(self.p)).cast("long").alias("expected_false"),
        )
