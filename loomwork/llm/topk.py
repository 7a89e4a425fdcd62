"""Exact top-k search by tiled matrix products, partial selection and tree merging.

Vectors are packed into tiles of at most ``tile`` rows, where they are read,
without a shuffle. Every tile of queries meets every tile of candidates once:
the pair of tile numbers is the join key, so the work is spread over as many
equal cells as there are pairs, whatever the keys of the rows are. Cells are listed
by joining tile numbers, a row for each tile, on the vectors' length: as many rows
as there are cells, which is the size of the task, and no vector among them. A cell is a
matrix product in blocks; of each block only the k + 1 best of every query
survive. The lists of a query then merge in a tree with a fan-in of ``FAN_IN``,
so no task ever holds more than FAN_IN lists of k + 1 entries for a query.

Scores are integers and exact: products run in float64 while every sum is below
2**53, else in int64, else in Python integers.

Defined cases: a vector that is null, or has a null or non-finite component,
takes no part; nor does a row with a null id, which could not be named. Vectors
of different lengths have no score together. A query never meets its own row;
a repeated row is another row and counts. Repeated query rows give a list each.
Ties go to the smaller id. Other columns are ignored. An empty table gives an
empty result. There are no texts; a very long vector is a row of a smaller tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import stored

#: Rows of a tile. 8,192 vectors of 64 small integers are 1 MB.
TILE = 8192
#: Lists that one merge of the tree takes at most.
FAN_IN = 16
#: Rows of the blocks of a product: 256 x 4,096 scores are 8 MB.
QUERY_BLOCK, CANDIDATE_BLOCK = 256, 4096

_PACKED = "dim int, uid long, n int, ids binary, vectors binary, kind string"
_FOUND = "uid long, row int, query_id long, own long, dim int, shard long, best array<struct<minus: long, vec_id: long>>"


def quantised(vectors: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as a long; null if any component is null or not finite."""
    wide = F.transform(vectors, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vectors.isNotNull() & ~bad, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _pack(tile: int):
    """Pack rows (vec_id, v) of a partition into tiles of one dimension each."""

    def run(batches):
        from pyspark import TaskContext

        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        made = 0

        def emit(dim: int):
            nonlocal made
            ids, rows = (np.concatenate([x[k] for x in held[dim]]) for k in (0, 1))
            held[dim] = [(ids[tile:], rows[tile:])] if len(ids) > tile else []
            ids, rows = ids[:tile], rows[:tile]
            order = np.argsort(ids, kind="stable")  # a smaller column is a smaller id
            most = int(np.abs(rows).max(initial=0)) if rows.size and rows.min() > -(2**63) else 2**63 if rows.size else 0
            kind = "i2" if most < 2**15 else "i4" if most < 2**31 else "i8"
            uid = (TaskContext.get().partitionId() << 32) + made
            made += 1
            row = {"dim": [dim], "uid": [uid], "n": [len(ids)], "ids": [ids[order].tobytes()], "vectors": [rows[order].astype(kind).tobytes()], "kind": [kind]}
            schema = pa.schema([("dim", pa.int32()), ("uid", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("kind", pa.string())])
            return pa.RecordBatch.from_pydict(row, schema)

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            size = lists.value_lengths().to_numpy().astype(np.int64)
            flat, first = lists.flatten().to_numpy(), np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                held.setdefault(dim, []).append((ids[at], flat[first[at][:, None] + np.arange(dim)] if dim else np.empty((len(at), 0), np.int64)))
                while sum(len(x[0]) for x in held[dim]) >= tile:
                    yield emit(dim)
        for dim in sorted(held):
            if held[dim]:
                yield emit(dim)

    return run


def _best(scores: np.ndarray, ids: np.ndarray, keep: int) -> list[list[tuple[int, int]]]:
    """Of each row the ``keep`` best (minus score, id); columns stand in order of id."""
    m = scores.shape[1]
    keep = min(keep, m)
    if scores.dtype == object:
        return [sorted(zip((-x for x in row), ids.tolist(), strict=True))[:keep] for row in scores.tolist()]
    # One number orders by score and, among equal scores, by the smaller column.
    top = int(np.abs(scores).max(initial=0)) + 1
    if top * m < 2**53:
        key = scores * m + np.arange(m - 1, -1, -1)
        at = np.argpartition(key, m - keep, axis=1)[:, m - keep :] if keep < m else np.tile(np.arange(m), (len(scores), 1))
        order = np.argsort(-np.take_along_axis(key, at, 1), axis=1, kind="stable")
        at = np.take_along_axis(at, order, 1)
    else:
        at = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
    found = np.take_along_axis(scores, at, 1)
    return [[(-int(s), int(v)) for s, v in zip(a, b, strict=True)] for a, b in zip(found, ids[at], strict=True)]


def _product(queries: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    if most < 2**53:
        return queries.astype(np.float64) @ candidates.astype(np.float64).T
    if most < 2**62:
        return queries @ candidates.T
    return queries.astype(object) @ candidates.T.astype(object)


_LONG = 2**63 - 1


def _cell(keep: int):
    """Tile by tile: the best ``keep`` of every query of a cell."""

    def run(batches):
        entry = pa.list_(pa.struct([("minus", pa.int64()), ("vec_id", pa.int64())]))
        schema = pa.schema([("uid", pa.int64()), ("row", pa.int32()), ("query_id", pa.int64()), ("own", pa.int64()), ("dim", pa.int32()), ("shard", pa.int64()), ("best", entry)])
        clip = lambda x: max(-_LONG, min(_LONG, x))  # noqa: E731  beyond a long, a score stays at its end
        for batch in batches:
            for x in batch.to_pylist():
                dim = x["dim"]
                q_ids, c_ids = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["c_ids"], np.int64)
                q = np.frombuffer(x["q_vectors"], x["q_kind"]).reshape(len(q_ids), dim).astype(np.int64)
                c = np.frombuffer(x["c_vectors"], x["c_kind"]).reshape(len(c_ids), dim).astype(np.int64)
                largest = [max((abs(int(f(m, initial=0))) for f in (np.max, np.min)), default=0) if m.size else 0 for m in (q, c)]
                most = largest[0] * max(largest) * max(dim, 1)
                for a in range(0, len(q_ids), QUERY_BLOCK):
                    block = q[a : a + QUERY_BLOCK]
                    lists: list[list] = [[] for _ in block]
                    for b in range(0, len(c_ids), CANDIDATE_BLOCK):
                        part = _best(_product(block, c[b : b + CANDIDATE_BLOCK], most), c_ids[b : b + CANDIDATE_BLOCK], keep)
                        lists = [sorted(m + n)[:keep] if m else n for m, n in zip(lists, part, strict=True)]
                    own = [clip(sum(int(y) ** 2 for y in row)) for row in block] if most >= 2**62 else (block * block).sum(1).tolist()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "uid": [x["q_uid"]] * len(block),
                            "row": list(range(a, a + len(block))),
                            "query_id": q_ids[a : a + len(block)].tolist(),
                            "own": own,
                            "dim": [dim] * len(block),
                            "shard": [x["c_uid"]] * len(block),
                            "best": [[{"minus": clip(s), "vec_id": v} for s, v in m] for m in lists],
                        },
                        schema,
                    )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, tile: int = TILE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows of ``vectors`` for every row of ``queries``.

    Both hold ``vec_id long`` and ``v array<long>``; the rows of ``queries`` are
    rows of ``vectors`` too, and a query leaves its own row out.
    """
    usable = lambda df: df.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select("vec_id", "v")
    packed = stored(usable(vectors).mapInArrow(_pack(tile), _PACKED), "topk-shards")
    # Queries are few beside the vectors: gathered from many tasks, they fill their tiles.
    asked = usable(queries)
    tiles = packed.agg(F.sum("n").alias("n")).first()["n"] or 0
    asked = stored(asked.repartition(max(1, -(-tiles // (tile * 64))), F.xxhash64("vec_id")).mapInArrow(_pack(tile), _PACKED), "topk-queries")
    name = lambda df, p: df.select("dim", *[F.col(c).alias(f"{p}_{c}") for c in ("uid", "ids", "vectors", "kind")])
    left, right = name(asked, "q"), name(packed, "c")
    # A cell is a pair of tile numbers; each tile travels once to every cell of its row or column.
    cells = left.select("dim", "q_uid").join(right.select("dim", "c_uid"), "dim")
    joined = cells.join(left.drop("dim"), "q_uid").join(right.drop("dim"), "c_uid")
    shards = packed.count()
    spread = joined.repartition(max(1, min(4096, shards * max(1, asked.count()))), "q_uid", "c_uid")
    found = spread.mapInArrow(_cell(k + 1), _FOUND)
    level = found.select("uid", "row", "query_id", "own", F.pmod(F.xxhash64("shard"), F.lit(max(1, -(-shards // FAN_IN)))).alias("node"), "best")
    nodes = max(1, -(-shards // FAN_IN))
    while True:
        merged = level.groupBy("uid", "row", "query_id", "own", "node").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
        if nodes == 1:
            break
        nodes = -(-nodes // FAN_IN)
        level = merged.withColumn("node", F.pmod("node", F.lit(nodes)))
    # The query's own row, if it is among the k + 1, leaves the list; equal entries are interchangeable.
    place = F.expr("array_position(transform(best, x -> x.vec_id = query_id AND x.minus = -own), true)")
    rows = merged.select("query_id", "best", place.cast("int").alias("p")).select("query_id", "p", F.posexplode("best").alias("i", "x"))
    rows = rows.where("p = 0 OR i <> p - 1").withColumn("rank", F.expr("CASE WHEN p > 0 AND i >= p THEN i ELSE i + 1 END").cast("int"))
    return rows.where(F.col("rank") <= k).select("query_id", "rank", F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))

