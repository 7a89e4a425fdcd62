"""SimHash near-dedup with a hierarchical index over fingerprints in Gray order.

A fingerprint has 64 bits; two link at ``radius`` (3) or fewer differing bits.
Cut into B blocks, two linked fingerprints agree in B - 3 of them at least, so
each distinct fingerprint is turned in as many ways as that many blocks can be
chosen, the chosen ones in front: four ways of 16 bits, ten of 25, twenty of 31
or thirty-five of 36. The fewest ways are taken that tell all fingerprints of the
input apart well enough, so groups that share the front bits stay small at any
size, and every choice finds every link:

1. turned fingerprints are range-partitioned and sorted by Gray rank, in which
   neighbours tend to differ in one bit; leaves of at most ``LEAF`` follow one
   another inside a run that shares its first bits;
2. each leaf is a node with the bits all its members share (a mask and the
   pattern under it). Leaves of a run are joined leaf to leaf by their nodes,
   and a pair whose patterns already differ in more than the radius is dropped
   before any member travels;
3. inside a pair of leaves an index of two levels is searched: an upper node
   holds the bits that all its lower nodes share, a lower node only the further
   ones, and differences accumulate on the way down; a group is left as soon as
   they exceed the radius. What remains is compared exactly;
4. of the links in a pair of leaves a spanning forest goes on (same components,
   never more rows than members), and components are found over all forests.

A run too large for one leaf is cut into more leaves, in any number of range
partitions, so no key gathers in a task. The index is exact: no link is lost.

Defined cases: a null or empty text has fingerprint 0 and links like any other.
Rows with equal ids count each, repeated rows too; they meet as one fingerprint. A
component of null ids only has a null component_id. A bit that is set in just half
of the hashes is 0. A very long text is hashed whole, some shingles at a time. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import components, in_steps, scratch, stored, text_buffers

#: Words of a shingle, seed of the hash, bits that may differ.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Blocks of a fingerprint at most.
BLOCKS = 7
#: Members of a leaf at most, and those that a run should have on average.
LEAF, RUN = 1024, 256
#: Fan-out of both index levels inside a leaf.
FAN = 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles that are hashed at once.
_SHINGLES = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text: words of the lower-cased bytes, their shingles' XXH64, majority of each bit."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()  # bytes split at 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    total, ones = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    for a in range(0, total, _SHINGLES):
        part = words[a : a + _SHINGLES + shingle - 1]
        n = max(1, len(part) - shingle + 1)
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        stops = ends[min(shingle, len(part)) - 1 :].tolist()
        h = np.fromiter((xxh64_intdigest(line[s:e], seed) for s, e in zip(starts, stops, strict=True)), np.uint64, n)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp long`` (the 64 bits as a signed number) for every row of ``docs``."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches):
        for batch in in_steps(batches, "text"):
            data, offsets = text_buffers(batch.column("text"))
            held = data.tobytes()
            fps = [fingerprint(held[a:b], shingle, seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _widths(blocks: int) -> list[int]:
    return [64 // blocks + (i < 64 % blocks) for i in range(blocks)]


def ways(blocks: int, radius: int = RADIUS) -> list[tuple[int, ...]]:
    """Orders of a fingerprint's blocks, from the highest bits: those that may agree in front."""
    return [(*front, *(b for b in range(blocks) if b not in front)) for front in combinations(range(blocks), blocks - radius)]


def front_bits(blocks: int, radius: int = RADIUS) -> int:
    """Bits of the narrowest front."""
    return sum(sorted(_widths(blocks))[: blocks - radius])


def scheme(n: int, radius: int = RADIUS, run: int = RUN) -> tuple[int, int]:
    """Blocks and front bits for ``n`` fingerprints, so that about ``run`` of them share the front bits."""
    bits = max(1, math.ceil(math.log2(max(2, n / run))))
    blocks = next((b for b in range(radius + 1, BLOCKS) if front_bits(b, radius) >= bits), BLOCKS)
    return blocks, min(bits, front_bits(blocks, radius))


def _moves(way: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(width, shift in the fingerprint, shift in the turned code) of every block."""
    widths = _widths(len(way))
    low = [64 - sum(widths[: b + 1]) for b in range(len(way))]
    placed = np.cumsum([widths[b] for b in way]).tolist()
    return [(widths[b], low[b], 64 - p) for b, p in zip(way, placed, strict=True)]


def _turned(fp: Column, way: tuple[int, ...]) -> Column:
    parts = [F.shiftleft(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1)), b) for w, a, b in _moves(way)]
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def turned_back(codes: np.ndarray, way: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(codes), np.uint64)
    for w, a, b in _moves(way):
        out |= ((codes >> np.uint64(b)) & np.uint64((1 << w) - 1)) << np.uint64(a)
    return out


def gray_rank(code: Column) -> Column:
    """The place of a code in Gray order, shifted so that signed numbers sort like unsigned ones."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(2**63)))


def _leaves(batches):
    """Cut rows (way, run, code), sorted, into leaves with the bits their members share."""
    from pyspark import TaskContext

    schema = pa.schema([("leaf", pa.int64()), ("way", pa.int32()), ("run", pa.int64()), ("mask", pa.int64()), ("pattern", pa.int64()), ("codes", pa.binary())])
    made = 0

    def node(key, codes):
        nonlocal made
        every, some = np.bitwise_and.reduce(codes), np.bitwise_or.reduce(codes)
        mask = np.array([~(every ^ some)], np.uint64)
        made += 1
        return {"leaf": (TaskContext.get().partitionId() << 32) + made, "way": key[0], "run": key[1], "mask": int(mask.view(np.int64)[0]), "pattern": int((mask & every).view(np.int64)[0]), "codes": codes.tobytes()}

    key, rest = None, np.empty(0, np.uint64)
    for batch in batches:
        way, run = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        codes = batch.column(2).to_numpy().view(np.uint64)
        edges = [0, *(np.flatnonzero((np.diff(way) != 0) | (np.diff(run) != 0)) + 1).tolist(), len(codes)]
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            here = (int(way[a]), int(run[a]))
            if here != key:
                if len(rest):
                    out.append(node(key, rest))
                key, rest = here, np.empty(0, np.uint64)
            rest = np.concatenate([rest, codes[a:b]])
            while len(rest) >= LEAF:
                out.append(node(key, rest[:LEAF]))
                rest = rest[LEAF:]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if len(rest):
        yield pa.RecordBatch.from_pylist([node(key, rest)], schema)


def _grouped(codes: np.ndarray, fan: int, under: np.ndarray | None = None):
    """Masks and patterns of groups of ``fan``; ``under``: the codes' masks, if they are nodes themselves."""
    mask, pattern = [], []
    for a in range(0, len(codes), fan):
        part = codes[a : a + fan]
        shared = ~(np.bitwise_and.reduce(part) ^ np.bitwise_or.reduce(part))
        if under is not None:
            shared &= np.bitwise_and.reduce(under[a : a + fan])
        mask.append(shared)
        pattern.append(part[0] & shared)
    return np.array(mask, np.uint64), np.array(pattern, np.uint64)


def links(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with ``left[i]`` and ``right[j]`` at most ``radius`` bits apart, by the index of two levels over ``right``."""
    low_mask, low_pattern = _grouped(right, FAN)
    high_mask, high_pattern = _grouped(low_pattern, FAN, low_mask)
    own_mask = low_mask & ~np.repeat(high_mask, FAN)[: len(low_mask)]  # what the upper node holds is not compared again
    found_i, found_j = [], []
    for a in range(0, len(left), 256):
        q = left[a : a + 256]
        differ = np.bitwise_count((q[:, None] ^ high_pattern) & high_mask)
        i, u = np.nonzero(differ <= radius)
        so_far = differ[i, u]
        low = (u[:, None] * FAN + np.arange(FAN)).ravel()
        i, so_far = np.repeat(i, FAN), np.repeat(so_far, FAN)
        there = low < len(low_mask)
        i, low, so_far = i[there], low[there], so_far[there]
        so_far = so_far + np.bitwise_count((q[i] ^ low_pattern[low]) & own_mask[low])
        keep = so_far <= radius
        i, low = i[keep], low[keep]
        j = (low[:, None] * FAN + np.arange(FAN)).ravel()
        i = np.repeat(i, FAN)
        there = j < len(right)
        i, j = i[there], j[there]
        keep = np.bitwise_count(q[i] ^ right[j]) <= radius
        found_i.append(i[keep] + a)
        found_j.append(j[keep])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place of its component under the links (i, j)."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if np.array_equal(before, label):
            return label
    return label


def _pairs(radius: int, blocks: int):
    every = ways(blocks, radius)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                left, same = np.frombuffer(x["l_codes"], np.uint64), x["l_leaf"] == x["r_leaf"]
                right = left if same else np.frombuffer(x["r_codes"], np.uint64)
                i, j = links(left, right, radius)
                if same:
                    i, j = i[i < j], j[i < j]
                    codes = left
                else:
                    j = j + len(left)
                    codes = np.concatenate([left, right])
                if not len(i):
                    continue
                label = forest(len(codes), i, j)
                hung = np.flatnonzero(label != np.arange(len(codes)))
                back = turned_back(codes, every[x["way"]])
                yield pa.RecordBatch.from_arrays([pa.array(back[hung].view(np.int64)), pa.array(back[label[hung]].view(np.int64))], schema=schema)

    return run


def leaf_pairs(fps: DataFrame, radius: int = RADIUS, run: int = RUN, blocks: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Leaves of the index, the pairs ``way, l_leaf, r_leaf`` of them that may hold links, and the blocks used."""
    least, bits = scheme(fps.count(), radius, run)
    blocks = blocks or least
    bits = min(bits, front_bits(blocks, radius))
    turns = F.explode(F.array(*[F.struct(F.lit(i).alias("way"), _turned(F.col("fp"), way).alias("code")) for i, way in enumerate(ways(blocks, radius))]))
    turned = fps.select(turns.alias("x")).select("x.way", F.shiftrightunsigned("x.code", 64 - bits).alias("run"), "x.code")
    ranked = turned.withColumn("rank", gray_rank(F.col("code")))
    dealt = ranked.repartitionByRange("way", "rank").sortWithinPartitions("way", "rank").select("way", "run", "code")
    leaves = stored(dealt.mapInArrow(_leaves, "leaf long, way int, run long, mask long, pattern long, codes binary"), "simhash-leaves")
    nodes = leaves.select("way", "run", "leaf", "mask", "pattern")
    l_nodes = nodes.select("way", "run", F.col("leaf").alias("l_leaf"), F.col("mask").alias("lm"), F.col("pattern").alias("lp"))
    r_nodes = nodes.select("way", "run", F.col("leaf").alias("r_leaf"), F.col("mask").alias("rm"), F.col("pattern").alias("rp"))
    apart = F.bit_count(F.col("lp").bitwiseXOR(F.col("rp")).bitwiseAND(F.col("lm")).bitwiseAND(F.col("rm")))
    near = l_nodes.join(r_nodes, ["way", "run"]).where((F.col("l_leaf") <= F.col("r_leaf")) & (apart <= radius)).select("way", "l_leaf", "r_leaf")
    return leaves, near, blocks


def linked(fps: DataFrame, radius: int = RADIUS, run: int = RUN, blocks: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` that span the components of the distinct fingerprints ``fp``."""
    if not 0 <= radius < 4:
        raise ValueError("fronts of this radius are not provided for")
    leaves, near, blocks = leaf_pairs(fps, radius, run, blocks)
    codes = lambda p: leaves.select(F.col("leaf").alias(f"{p}_leaf"), F.col("codes").alias(f"{p}_codes"))
    tiles = near.join(codes("l"), "l_leaf").join(codes("r"), "r_leaf").select("way", "l_leaf", "r_leaf", "l_codes", "r_codes")
    # Some sixteen leaves a task, but no more tasks than a driver can schedule.
    tasks = max(1, min(8192, -(-leaves.count() // 16)))
    return tiles.repartition(tasks, "l_leaf", "r_leaf").mapInArrow(_pairs(radius, blocks), "a long, b long")


def simhash_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    fps = stored(fingerprints(docs, id_column, text_column), "simhash-fps")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    with scratch(docs.sparkSession) as kept:
        kept.append(components(linked(distinct.select("fp"), radius), "simhash"))
    roots = kept[0]
    placed = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
