import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import simhash
from loomwork.llm.catalogue import QUERIES
from loomwork.llm.shared import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=3):
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {x: min((rows[i][0] for i in range(len(rows)) if label[i] == x and rows[i][0] is not None), default=None) for x in set(label)}
    return sorted(((r[0], f"{f:016x}", least[x]) for r, f, x in zip(rows, fps, label)), key=repr)


def run(docs):
    return sorted(map(tuple, simhash.simhash_dedup(docs).collect()), key=repr)


def test_odd_documents(docs_of, odd_rows):
    assert run(docs_of(odd_rows)) == brute(odd_rows)


def test_near_copies(docs_of):
    rng = random.Random(3)
    rows = []
    for g in range(8):
        body = [f"w{rng.randrange(200)}" for _ in range(150)]
        for k in range(6):
            changed = list(body)
            for _ in range(rng.randrange(4)):
                changed[rng.randrange(150)] = "other"
            rows.append((g * 10 + k, " ".join(changed), "", "", 0))
    got = run(docs_of(rows))
    assert got == brute(rows) and len({r[2] for r in got}) < len(rows)


def test_empty_table(docs_of):
    assert run(docs_of([])) == []


def clustered(rng, n):
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 12))]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("n", [1, 17, 300, 900])
def test_index_finds_every_link(n):
    rng = random.Random(n)
    left, right = clustered(rng, n), clustered(rng, n)
    right[: n // 2] = left[: n // 2]
    i, j = simhash.links(left, right)
    a, b = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= 3)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(a.tolist(), b.tolist()))


def test_all_links_across_leaves_and_partitions(spark, monkeypatch):
    """Runs that fill several leaves, in several range partitions."""
    rng = random.Random(9)
    fps = clustered(rng, 3000)
    low = np.array([rng.getrandbits(20) for _ in range(1500)], np.uint64)  # three quarters equal: one run holds them all
    every = np.unique(np.concatenate([fps, low]))
    df = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    edges = simhash.linked(df).collect()
    label = simhash.forest(len(every), *np.nonzero(np.bitwise_count(every[:, None] ^ every[None, :]) <= 3))
    at = {int(x): k for k, x in enumerate(every.view(np.int64))}
    a, b = np.array([at[e.a] for e in edges]), np.array([at[e.b] for e in edges])
    assert (np.bitwise_count(every[a] ^ every[b]) <= 64).all() and np.array_equal(simhash.forest(len(every), a, b), label)


def test_gray_neighbours_differ_in_one_bit(spark):
    df = spark.range(256).select(F.col("id"), simhash.gray_rank(F.col("id")).alias("rank")).orderBy("rank")
    codes = [r.id for r in df.collect()]
    assert all((a ^ b).bit_count() == 1 for a, b in zip(codes, codes[1:]))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (-4, -9)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "test").collect()))
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(300)) and got[-4] == got[-9] == -9


def test_radius_is_bounded(spark):
    with pytest.raises(ValueError):
        simhash.linked(spark.createDataFrame([(1,)], "fp long"), 4)


@pytest.mark.parametrize("blocks", [4, 5, 6, 7])
def test_every_way_of_turning_finds_every_link(spark, blocks):
    rng = random.Random(blocks)
    every = np.unique(clustered(rng, 500))
    some = spark.createDataFrame([(int(x),) for x in every[:20].view(np.int64)], "fp long")
    turned = some.select("fp", *[simhash._turned(F.col("fp"), way).alias(f"w{i}") for i, way in enumerate(simhash.ways(blocks))]).collect()
    for i, way in enumerate(simhash.ways(blocks)):
        codes = np.array([r[f"w{i}"] for r in turned], np.int64).view(np.uint64)
        assert simhash.turned_back(codes, way).view(np.int64).tolist() == [r.fp for r in turned]
    edges = simhash.linked(spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long"), run=8, blocks=blocks).collect()
    at = {int(x): k for k, x in enumerate(every.view(np.int64))}
    a, b = np.array([at[e.a] for e in edges]), np.array([at[e.b] for e in edges])
    label = simhash.forest(len(every), *np.nonzero(np.bitwise_count(every[:, None] ^ every[None, :]) <= 3))
    assert np.array_equal(simhash.forest(len(every), a, b), label)


def test_groups_stay_small_at_any_size():
    assert [simhash.front_bits(b) for b in (4, 5, 6, 7)] == [16, 25, 31, 36]
    assert [simhash.scheme(n)[0] for n in (10, 10**6, 2**24, 2**24 + 1, 10**9, 10**10, 10**12)] == [4, 4, 4, 5, 5, 6, 7]
    assert all(n / 2 ** simhash.scheme(n)[1] <= simhash.RUN for n in (10**k for k in range(13)))
    for blocks in (4, 5, 6, 7):  # whatever three blocks differ, the others are in front of some way
        fronts = {frozenset(w[: blocks - 3]) for w in simhash.ways(blocks)}
        assert all(frozenset(range(blocks)) - set(x) in fronts for x in itertools.combinations(range(blocks), 3))


def test_leaf_pairs_grow_in_proportion(spark):
    rng = random.Random(1)
    made = []
    for n in (2000, 8000, 32000):
        fps = spark.createDataFrame([(rng.getrandbits(64) - 2**63,) for _ in range(n)], "fp long")
        made.append(simhash.leaf_pairs(fps, run=1)[1].count() / (n * len(simhash.ways(simhash.scheme(n, run=1)[0]))))
    assert max(made) <= 1.5 * min(made)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op6_simhash"](spark, sf_dir).collect()), key=repr) == brute(rows)
