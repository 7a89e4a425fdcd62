"""Near copies by their sets of word shingles: an exact join at a Jaccard similarity of 0.8.

1. A text is the set of its shingles' hashes. A near copy has four fifths of
   its members in common with another row, so a row of which more than a fifth
   of the members are in no other row goes no further. This is told a part of the
   hashes' range at a time: after the first part most rows are gone, and the others
   need be read for the rows that are left only. Members that only such rows shared
   are then in one row, which is repeated while it drops many rows.
2. Members are put in order of the rows that have them, the rarest first; those that
   no other row has come before all others. Two near sets have a member in common
   among the first fifth of each, so these are the keys. A passage that many texts
   share is at the end of the order and makes hardly a key.
3. Every row is compared with the first row of each of its keys, and components
   are found over the pairs that are near. So a group of many copies costs a
   comparison for each row and key, not for each pair.
4. Rows that share a key and aren't in one component yet are compared as well.
   No pair that is near stays apart.

Pairs whose sizes, places in the order, or parities leave no room for enough common
members are dropped before any set travels; parities have about a bit for a member, so
hardly a pair below the similarity passes. The others are compared exactly, a part
of the hashes' range at a time, so a part of the sets is on the way at once.

Defined cases: words as in ``simhash``, ASCII lower-cased. A text of fewer words
than a shingle is one shingle; a text without words is near to none. Shingles
are compared by 64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import components, discard, in_steps, lower_ascii, scratch, stored
from loomwork.llm.substring_dedup import _ODD_WORD, _STEP, _spans_hash, _Words

#: Words of a shingle.
SHINGLE = 5
#: Longs of a set's parities at least, and bits that number the parts of the hashes' range.
_LONGS, _PART_BITS = 8, 2
#: Rows are dropped by what the others have while a round leaves less than this of them.
FALLING = 0.9


def sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The shingles of each text as sorted distinct hashes."""
    w = _Words(column)
    w.hash()
    out = []
    for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
        n = min(b - a, shingle)
        starts = np.arange(a, b - n + 1) if n else np.empty(0, np.int64)
        out.append(np.unique(_spans_hash(w.sums, _ODD_WORD, starts, starts + n)))
    return out


def parities(members: np.ndarray) -> list[int]:
    """How often members fall in each place, modulo two, as longs: a power of two of them, and a bit for each member or more.

    A member that only one of two sets has flips one place, so two sets differ
    in no more places than they have members not in common. Of twice as many
    longs the halves together are those of half as many.
    """
    longs = max(_LONGS, 1 << max(0, -(-len(members) // 64) - 1).bit_length())
    odd = np.bincount((members >> np.uint64(32)).astype(np.int64) % (64 * longs), minlength=64 * longs) % 2
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64).tolist()


def _apart(a: Column, b: Column) -> Column:
    """Places in which the parities of two sets differ; sets of similar sizes have as many longs, or one has twice as many."""
    half = lambda x, other: F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, 1, F.size(other)), F.slice(x, F.size(other) + 1, F.size(other)), lambda p, q: p.bitwiseXOR(q))).otherwise(x)
    return F.aggregate(F.zip_with(half(a, b), half(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)


def _member_rows(part: int):
    """The size of every text's set, and its members in one part of the hashes' range."""

    def run(batches):
        for batch in in_steps(batches, "text", _STEP):
            each = sets(batch.column("text"))
            own = [x[x >> np.uint64(64 - _PART_BITS) == part].view(np.int64) for x in each]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([len(x) for x in each], pa.int32()), pa.array(own, pa.list_(pa.int64()))], ["row", "n", "keys"])

    return run


def _sign_rows(batches):
    for batch in batches:
        each = [parities(np.array(x, np.int64).view(np.uint64)) for x in batch.column("keys").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "n", "s")), pa.array(each, pa.list_(pa.int64()))], ["row", "n", "s", "sign"])


def _shared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``row, n, lone`` of which a fifth of the members at most are in no other row, and ``row, key``: the other members."""
    left, parts = None, []
    for part in range(1 << _PART_BITS):
        texts = rows if left is None else rows.join(left.select(F.col("row").alias("_row")), "_row", "left_semi")
        each = stored(texts.mapInArrow(_member_rows(part), "row long, n int, keys array<long>"), "shingle-members")
        keys = each.select("row", F.explode("keys").alias("key"))
        several = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "shingle-several")
        parts.append(stored(keys.join(several.hint("shuffle_hash"), "key", "left_semi"), "shingle-shared"))
        lone = each.select("row", "n", F.size("keys").alias("own")).join(parts[-1].groupBy("row").agg(F.count(F.lit(1)).alias("c")), "row", "left")
        lone = lone.select("row", "n", (F.col("own") - F.coalesce("c", F.lit(0))).alias("lone"))
        if left is not None:
            lone = lone.join(left.select("row", F.col("lone").alias("more")), "row").select("row", "n", (F.col("lone") + F.col("more")).alias("lone"))
        before, left = left, stored(lone.where("n > 0 AND 5 * lone <= n"), "shingle-left")
        discard(each, several, *([before] if before is not None else []))
    members = stored(reduce(DataFrame.unionByName, parts).join(left.select("row"), "row", "left_semi"), "shingle-shared")
    discard(*parts)
    return left, members


def _sets(rows: DataFrame) -> DataFrame:
    """``row, n, s, keys`` of the rows that may be near another: the size of the set and its ``s`` members that others have, the rarest first."""
    left, members = _shared(rows)
    before, now = None, left.count()
    while before is None or now < FALLING * before:
        # What only rows shared that are gone is in one row now.
        several = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        counted = stored(members.select("row", "key").join(several, "key"), "shingle-counted")
        size = counted.groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("s"))
        fewer = stored(left.select("row", "n").join(size, "row").where("5 * s >= 4 * n"), "shingle-left")
        discard(members, left)
        members, left = stored(counted.join(fewer.select("row"), "row", "left_semi"), "shingle-counted"), fewer
        discard(counted)
        before, now = now, left.count()
    held = members.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("members"))
    found = stored(left.join(held, "row").select("row", "n", "s", F.col("members.key").alias("keys")), "shingle-sets")
    discard(members, left)
    return found


def _room() -> Column:
    """Whether two sets that share a key can have enough members in common, were it their first."""
    l_n, r_n = F.col("l.n"), F.col("r.n")
    return (5 * F.least(l_n, r_n) >= 4 * F.greatest(l_n, r_n)) & (9 * F.least("l.rest", "r.rest") >= 4 * (l_n + r_n))


def _part(keys: str, part: int) -> Column:
    return F.filter(keys, lambda k: F.shiftrightunsigned(k, 64 - _PART_BITS) == part)


def _verified(pairs: DataFrame, whole: DataFrame, signs: DataFrame) -> DataFrame:
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # Only pairs whose parities leave it open are compared by their members. Members in one row only are not in common.
    of = lambda c: signs.select(F.col("row").alias(c), F.col("n").alias(f"{c}_n"), (F.col("n") - F.col("s")).alias(f"{c}_lone"), F.col("sign").alias(f"{c}_sign"))
    apart = F.col("a_lone") + F.col("b_lone") + _apart(F.col("a_sign"), F.col("b_sign"))
    open_ = pairs.join(of("a"), "a").join(of("b"), "b").where(9 * apart <= F.col("a_n") + F.col("b_n"))
    pairs = stored(open_.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n")), "shingle-pairs")
    counts = []
    for part in range(1 << _PART_BITS):
        both = pairs.join(whole.select(F.col("row").alias("a"), _part("keys", part).alias("x")), "a")
        both = both.join(whole.select(F.col("row").alias("b"), _part("keys", part).alias("y")), "b")
        counts.append(stored(both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common")), "shingle-common"))
    common = reduce(DataFrame.unionByName, counts).groupBy("a", "b").agg(F.sum("common").alias("common"))
    # A Jaccard similarity of 0.8 is four ninths of both sizes in common.
    found = stored(common.join(pairs, ["a", "b"]).where(9 * F.col("common") >= 4 * F.col("n")).select("a", "b"), "shingle-near")
    discard(pairs, *counts)
    return found


def near_links(rows: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all near pairs among rows ``_row, text``; ``_row`` is unique."""
    with scratch(rows.sparkSession) as kept:
        kept.append(_near_links(rows))
    return kept[0]


def _near_links(rows: DataFrame) -> DataFrame:
    whole = _sets(rows.select("_row", lower_ascii(F.coalesce("text", F.lit(""))).alias("text")))
    signs = stored(whole.mapInArrow(_sign_rows, "row long, n int, s int, sign array<long>"), "shingle-signs")
    # Places in the order are counted from its end, as the members that one row has come first.
    first_fifth = F.slice("keys", F.lit(1), F.col("s") - F.ceil(4 * F.col("n") / 5).cast("int") + 1)
    keys = whole.select("row", "n", "s", F.posexplode(first_fifth).alias("place", "key")).select("key", "row", "n", (F.col("s") - F.col("place")).alias("rest"))
    heads = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "n", "rest")).alias("head")).where("c > 1")
    heads = stored(heads.select("key", "head.*"), "shingle-heads")
    shared = stored(keys.join(heads.select("key"), "key", "left_semi"), "shingle-keys")

    met = shared.alias("l").join(heads.alias("r"), "key").where((F.col("l.row") != F.col("r.row")) & _room())
    first = _verified(met.select(F.col("l.row").alias("a"), F.col("r.row").alias("b")), whole, signs)
    discard(heads)

    # What the comparisons with the first rows did not join.
    roots = components(first, "shingle").select(F.col("vertex").alias("row"), "root")
    placed = shared.join(roots, "row", "left").select("key", "row", "n", "rest", F.coalesce("root", "row").alias("root"))
    placed = stored(placed, "shingle-placed")
    discard(shared)
    several = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    apart = stored(placed.join(several, "key", "left_semi"), "shingle-apart")
    discard(placed)
    met = apart.alias("l").join(apart.alias("r"), "key").where((F.col("l.row") < F.col("r.row")) & (F.col("l.root") != F.col("r.root")) & _room())
    rest = _verified(met.select(F.col("l.row").alias("a"), F.col("r.row").alias("b")), whole, signs)
    return stored(first.unionByName(rest), "shingle-links")
