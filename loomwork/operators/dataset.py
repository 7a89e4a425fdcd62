"""A lazy collection of Python objects: maps, filters, reductions and joins by key, sorting, collect and take.

Functions run in the order they were chained, in one pass over each partition;
nothing happens before ``collect`` or ``take``. Objects travel pickled. Keys of
reductions and joins must be JSON values: a key is known by its JSON text, so ``1``
and ``"1"`` are different keys, and a tuple comes back as the list it is in JSON.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomwork.operators.mapreduce import groups

_ITEM = pa.schema([("item", pa.binary())])
_KEYED = pa.schema([("key", pa.string()), ("item", pa.binary())])


def _out(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class Context:
    """Where collections come from."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def text_file(self, path: str) -> Dataset:
        """Lines of text files, without their line feeds."""
        return Dataset(self.spark.read.text(path).selectExpr("value AS item"), raw=True)

    def from_frame(self, df: DataFrame) -> Dataset:
        """Rows of a DataFrame as tuples; of an only column, its values."""

        def run(batches):
            columns = ([c.to_pylist() for c in b.columns] for b in batches)
            return _out(((pickle.dumps(x if len(x) > 1 else x[0]),) for held in columns for x in zip(*held, strict=True)), _ITEM)

        return Dataset(df.mapInArrow(run, "item binary"))

    def from_list(self, items: Iterable[Any]) -> Dataset:
        rows = [(bytearray(pickle.dumps(x)),) for x in items]
        return Dataset(self.spark.createDataFrame(rows, "item binary"))


class Dataset:
    """A plan: a DataFrame of objects and the functions that are still to be applied to it."""

    def __init__(self, source: DataFrame, steps: tuple[tuple[str, Callable], ...] = (), raw: bool = False):
        self._source, self._steps, self._raw = source, steps, raw

    def map(self, fn: Callable[[Any], Any]) -> Dataset:
        """One object for each."""
        return Dataset(self._source, (*self._steps, ("map", fn)), self._raw)

    def flat_map(self, fn: Callable[[Any], Iterable[Any]]) -> Dataset:
        """Any number of objects for each."""
        return Dataset(self._source, (*self._steps, ("flat", fn)), self._raw)

    def filter(self, fn: Callable[[Any], bool]) -> Dataset:
        """The objects for which ``fn`` holds."""
        return Dataset(self._source, (*self._steps, ("filter", fn)), self._raw)

    def _pass(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[Any]]:
        steps, raw = self._steps, self._raw

        def run(batches):
            items: Iterator[Any] = (x if raw else pickle.loads(x) for b in batches for x in b.column(0).to_pylist())
            for kind, fn in steps:
                if kind == "map":
                    items = map(fn, items)
                elif kind == "filter":
                    items = filter(fn, items)
                else:
                    items = (y for ys in map(fn, items) for y in ys)
            return items

        return run

    def map_values(self, fn: Callable[[Any], Any]) -> Dataset:
        """(key, fn(value)) of pairs."""
        return self.map(lambda pair: (pair[0], fn(pair[1])))

    def keys(self) -> Dataset:
        return self.map(lambda pair: pair[0])

    def values(self) -> Dataset:
        return self.map(lambda pair: pair[1])

    def union(self, other: Dataset) -> Dataset:
        """The objects of both, repeated ones too."""
        return Dataset(self.to_frame().unionByName(other.to_frame()))

    def distinct(self) -> Dataset:
        """Each object once; objects are told apart by their JSON."""
        return self.map(lambda x: (x, x)).reduce_by_key(lambda a, _: a).values()

    def combine_by_key(self, create: Callable[[Any], Any], add: Callable[[Any, Any], Any], merge: Callable[[Any, Any], Any]) -> Dataset:
        """(key, state) with the states of equal keys.

        ``create`` makes a state of a first value, ``add`` takes a further value
        into a state, ``merge`` takes two states together. A key gets a state in
        every task, and more if a task has many keys, so ``create`` must not
        add what should count once for a key. States merge after they are dealt
        by key, and a frequent key is a state or a few of each task.
        """
        before = self._pass()

        def fold_here(batches):
            def states():
                held: dict[str, Any] = {}
                for key, value in before(batches):
                    k = json.dumps(key)
                    held[k] = add(held[k], value) if k in held else create(value)
                    if len(held) >= 50_000:
                        yield from held.items()
                        held = {}
                yield from held.items()

            return _out(((k, pickle.dumps(v)) for k, v in states()), _KEYED)

        def fold(batches):
            from functools import reduce

            pairs = ((k, pickle.loads(v)) for b in batches for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            return _out(((pickle.dumps((json.loads(k), reduce(merge, states))),) for k, states in groups(pairs)), _ITEM)

        dealt = self._source.mapInArrow(fold_here, "key string, item binary").repartition("key").sortWithinPartitions("key")
        return Dataset(dealt.mapInArrow(fold, "item binary"))

    def reduce_by_key(self, fn: Callable[[Any, Any], Any]) -> Dataset:
        """(key, value) with equal keys' values folded by ``fn``, which must be associative and commutative."""
        return self.combine_by_key(lambda value: value, fn, fn)

    def _keyed(self) -> DataFrame:
        run = self._pass()
        return self._source.mapInArrow(lambda batches: _out(((json.dumps(k), pickle.dumps(v)) for k, v in run(batches)), _KEYED), "key string, item binary")

    def join(self, other: Dataset) -> Dataset:
        """(key, (value, other value)) of all pairs of equal keys; the planner picks and splits the join."""
        both = self._keyed().join(other._keyed().withColumnRenamed("item", "other"), "key")

        def paired(batches):
            rows = (x for b in batches for x in zip(*[b.column(c).to_pylist() for c in ("key", "item", "other")], strict=True))
            return _out(((pickle.dumps((json.loads(k), (pickle.loads(v), pickle.loads(w)))),) for k, v, w in rows), _ITEM)

        return Dataset(both.mapInArrow(paired, "item binary"))

    def sort_by(self, fn: Callable[[Any], float | str], ascending: bool = True) -> Dataset:
        """The objects in order of ``fn``, which gives numbers or gives texts."""
        run = self._pass()
        schema = pa.schema([("number", pa.float64()), ("text", pa.string()), ("item", pa.binary())])

        def placed(batches):
            for x in run(batches):
                at = fn(x)
                yield (None, at, pickle.dumps(x)) if isinstance(at, str) else (float(at), None, pickle.dumps(x))

        rows = self._source.mapInArrow(lambda batches: _out(placed(batches), schema), "number double, text string, item binary")
        return Dataset(rows.orderBy("number", "text", ascending=ascending).select("item"))

    def reduce(self, fn: Callable[[Any, Any], Any]) -> Any:
        """All objects folded by ``fn``, associative and commutative: in each task first, then the tasks' results on the driver."""
        from functools import reduce

        run = self._pass()

        def fold(batches):
            held = list(islice(accumulated := iter(run(batches)), 1))
            return _out(((pickle.dumps(reduce(fn, accumulated, x)),) for x in held), _ITEM)

        found = [pickle.loads(bytes(r[0])) for r in self._source.mapInArrow(fold, "item binary").collect()]
        if not found:
            raise ValueError("there is nothing to reduce")
        return reduce(fn, found)

    def to_frame(self) -> DataFrame:
        """``item binary``: the pickled objects."""
        run = self._pass()
        return self._source.mapInArrow(lambda batches: _out(((pickle.dumps(x),) for x in run(batches)), _ITEM), "item binary")

    def to_rows(self, schema: str) -> DataFrame:
        """Tuples as rows of a schema."""
        run, kinds = self._pass(), to_arrow_schema(T.StructType.fromDDL(schema))
        return self._source.mapInArrow(lambda batches: _out(iter(run(batches)), kinds), schema)

    def cache(self) -> Dataset:
        """The same objects, worked out once and held on the executors; what one loses is worked out again."""
        return Dataset(self.to_frame().persist())

    def collect(self) -> list[Any]:
        """All objects, on the driver: for results that are small."""
        return [pickle.loads(bytes(r[0])) for r in self.to_frame().collect()]

    def take(self, n: int) -> list[Any]:
        """The first ``n`` objects."""
        return [pickle.loads(bytes(r[0])) for r in self.to_frame().take(n)]

    def count(self) -> int:
        return self.to_frame().count()
