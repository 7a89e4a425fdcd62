import math
import random

import pytest
from pyspark.sql import functions as F

from loomwork.llm import topk
from loomwork.llm.catalogue import ORACLES, QUERIES


def brute(rows, k, is_query, scale=1024):
    usable = [(i, [math.floor(float(x) * scale) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(usable):
        if is_query(q):
            found = sorted((-sum(a * b for a, b in zip(v, u)), i) for m, (i, u) in enumerate(usable) if m != n and len(u) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, k, tile):
    df = spark.createDataFrame([(i, v, "extra") for i, v in rows], "vec_id long, embedding array<float>, v string")
    df = df.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return sorted(map(tuple, topk.top_k(df, df.where("vec_id % 3 = 0"), k, tile).collect()))


@pytest.mark.parametrize("tile", [4, 64])
def test_against_brute_force(spark, tile):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(60)]  # many ties
    assert run(spark, rows, 5, tile) == brute(rows, 5, lambda i: i % 3 == 0)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, []), (7, [1.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (9, [3.0, -2.0]), (None, [1.0, 1.0])]
    assert run(spark, rows, 10, 4) == brute(rows, 10, lambda i: i % 3 == 0)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**s) for s in (20 + i % 3, 10, i % 7)]) for i in range(12)]
    assert run(spark, rows, 3, 4) == brute(rows, 3, lambda i: i % 3 == 0)


def test_many_equal_vectors(spark):
    rows = [(i, [0.5, -0.5]) for i in range(100)]
    assert run(spark, rows, 4, 8) == brute(rows, 4, lambda i: i % 3 == 0)


def test_empty_table(spark):
    assert run(spark, [], 4, 8) == [] and run(spark, [(1, [1.0])], 4, 8) == [] and run(spark, [(3, [1.0])], 4, 8) == []


def test_query_matches_sql(same_as_sql):
    same_as_sql(QUERIES["op1_topk_search"], ORACLES["op1_topk_search"])


def test_other_columns_are_ignored(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    more = df.select("*", *[F.lit("extra").alias(c) for c in "dim uid n ids vectors kind query_id own shard best node rank score q_uid c_uid row i x p minus".split()])
    assert sorted(map(tuple, topk.top_k(more, more.where("vec_id % 3 = 0"), 4, 8).collect())) == brute(rows, 4, lambda i: i % 3 == 0)
