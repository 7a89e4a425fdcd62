"""Map/reduce with user functions in Python.

``Job`` is for functions that Spark can't see into; whatever can be said in
columns belongs into a query instead. Pairs travel as JSON texts, are dealt by
key and sorted by (key, value) bytes; a reducer gets an iterator over one key's
values and may stop early or yield any number of pairs. Groups are streamed, so
a large one costs time in its task but no memory. A ``combine`` function
(associative, commutative) reduces values before they are dealt, and then a
frequent key is a pair of each task.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.strings import json_value, shard

Pair = tuple[Any, Any]
_PAIR = "key string, value string"
#: Distinct keys that a combiner holds before it hands them on.
_HELD = 200_000
_quoted = json.encoder.encode_basestring_ascii


def encode(key: Any) -> str:
    """A key or value as JSON; equal keys give equal texts. Texts and whole numbers, the usual ones, need no encoder."""
    kind = type(key)
    return _quoted(key) if kind is str else repr(key) if kind is int else json.dumps(key)


def decode(text: str) -> Any:
    """What ``encode`` made a text of."""
    if text.isdigit():
        return int(text)
    return text[1:-1] if text[0] == '"' and "\\" not in text else json.loads(text)


def line(key: Any, value: Any) -> str:
    """A pair as a line: JSON, a tab, JSON. JSON has no bare tab, so the first one separates."""
    return f"{encode(key)}\t{encode(value)}"


def pair(text: str) -> Pair:
    """The pair of a line."""
    key, _, value = text.rstrip().partition("\t")
    return json.loads(key), json.loads(value)


def line_column(key, value):
    """``line`` as a column expression."""
    return F.concat_ws("\t", json_value(key), json_value(value))


def _batches(rows: Iterator[tuple], names: tuple[str, ...], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], list(names))
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], list(names))


def _items(batches) -> Iterator[Any]:
    for batch in batches:
        if batch.num_columns == 1:
            yield from batch.column(0).to_pylist()
        else:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def groups(pairs: Iterable[Pair]) -> Iterator[tuple[Any, Iterator[Any]]]:
    """Keys of sorted pairs, each with an iterator over its values. A group that is left early is skipped to its end."""
    from itertools import groupby
    from operator import itemgetter

    for key, members in groupby(pairs, itemgetter(0)):
        yield key, map(itemgetter(1), members)


class Peekable:
    """An iterator that can show its next item and take items back, ``most`` of them at a time."""

    def __init__(self, items: Iterable[Any], most: int = 1):
        self._items, self._most = iter(items), most
        self._back: deque = deque()

    def __iter__(self) -> Peekable:
        return self

    def __next__(self) -> Any:
        return self._back.popleft() if self._back else next(self._items)

    def push_back(self, item: Any) -> None:
        """The next item is this one."""
        if len(self._back) >= self._most:
            raise OverflowError(f"no more than {self._most} items can be pushed back")
        self._back.appendleft(item)

    def peek(self) -> Any:
        """The next item, which stays the next; StopIteration if there is none."""
        if not self._back:
            self._back.append(next(self._items))
        return self._back[0]

    def has_more(self) -> bool:
        try:
            self.peek()
        except StopIteration:
            return False
        return True


class Job:
    """A map and a reduce function; override both, or pass them."""

    def __init__(self, map: Callable | None = None, reduce: Callable | None = None, combine: Callable[[Any, Any], Any] | None = None):  # noqa: A002
        self._map, self._reduce, self._combine = map, reduce, combine

    def map(self, item: Any) -> Iterable[Any]:
        """Yield any number of items, or of (key, value) pairs if a reduce follows."""
        if self._map is None:
            raise NotImplementedError("map")
        return self._map(item)

    def reduce(self, key: Any, values: Iterator[Any]) -> Iterable[Pair]:
        """Yield any number of (key, value) pairs."""
        if self._reduce is None:
            raise NotImplementedError("reduce")
        return self._reduce(key, values)

    def map_only(self, items: DataFrame) -> DataFrame:
        """``value string``: what ``map`` yields for every row (an only column's value, else a tuple), as text; nothing is shuffled."""
        job = self

        def run(batches):
            return _batches(((str(y),) for x in _items(batches) for y in job.map(x)), ("value",))

        return items.mapInArrow(run, "value string")

    def _mapped(self, items: DataFrame) -> DataFrame:
        job, combine = self, self._combine

        def combined(pairs: Iterator[Pair]) -> Iterator[tuple[str, Any]]:
            texts: dict[str, Any] = {}  # keys that are texts: encoded once for all their values
            others: dict[str, Any] = {}
            for key, value in pairs:
                k, held = (key, texts) if type(key) is str else (encode(key), others)
                held[k] = combine(held[k], value) if k in held else value
                if len(texts) + len(others) >= _HELD:
                    yield from ((encode(k), v) for k, v in texts.items())
                    yield from others.items()
                    texts, others = {}, {}
            yield from ((encode(k), v) for k, v in texts.items())
            yield from others.items()

        def run(batches):
            pairs = (y for x in _items(batches) for y in job.map(x))
            rows = combined(pairs) if combine else ((encode(k), v) for k, v in pairs)
            return _batches(((k, encode(v)) for k, v in rows), ("key", "value"))

        return items.mapInArrow(run, _PAIR)

    def sorted_runs(self, items: DataFrame) -> DataFrame:
        """Mapped pairs as JSON ``key, value``, dealt by key and sorted inside each partition by the bytes of both."""
        return self._mapped(items).repartition("key").sortWithinPartitions("key", "value")

    def map_reduce(self, items: DataFrame, key: str = "string", value: str = "long") -> DataFrame:
        """``key, value`` of all reduced pairs, read as the given types."""
        job, combine = self, self._combine

        def run(batches):
            def decoded():
                for k, v in _items(batches):
                    yield k, decode(v)

            def reduced():
                for k, values in groups(decoded()):
                    if combine:
                        from functools import reduce

                        values = iter([reduce(combine, values)])
                    yield from job.reduce(decode(k), values)

            return _batches(((f'{{"x": {encode(k)}}}', f'{{"x": {encode(v)}}}') for k, v in reduced()), ("key", "value"))

        out = self.sorted_runs(items).mapInArrow(run, _PAIR)
        return out.select(F.from_json("key", f"x {key}")["x"].alias("key"), F.from_json("value", f"x {value}")["x"].alias("value"))


def text_of(reduced: DataFrame) -> DataFrame:
    """``value``: reduced pairs as Python writes a tuple, whatever the types of key and value."""

    def run(batches):
        return _batches(((str((k, v)),) for k, v in _items(batches)), ("value",))

    return reduced.select("key", "value").mapInArrow(run, "value string")


def assign_shards(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows with ``shard``, the stable shard of a key."""
    return rows.withColumn("shard", shard(F.col(key), n))


def shard_stats(assigned: DataFrame) -> DataFrame:
    """``shard, lines``."""
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("lines"))
