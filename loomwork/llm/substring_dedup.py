"""Substring dedup by seed and extend.

Words covered by a window of ``window`` words that also starts elsewhere are
removed. The documents are never compared in pairs:

1. Seeds. Every window selects as its anchor the leftmost smallest hash among
   its ``seed``-word grams (winnowing), so equal windows have equal anchors. The
   windows of one document that share an anchor's place form a run, of which
   there are about 2 / (window - seed + 2) for each word. Documents are joined
   on anchors: a run whose anchor occurs once in the corpus is unique and goes
   no further. Runs that are alike over their whole reach repeat as a whole, and
   one stands for all from here on.
2. Extension. A match of an anchor is extended both ways by the words around it.
   Two occurrences of an anchor that lie in one repeated window agree on half of
   the words that the window adds, on the left side or on the right one, so
   they are joined on the words of either side; then on half of the rest on
   either side of these, and so on. An occurrence that agrees with no other is
   left out at each step, and after about five steps the matches are complete
   windows. Steps are joins on (anchor, words matched so far): a step costs a row
   for each occurrence and side, however many occurrences an anchor has.
3. Maximal repeats. A document's repeated windows that overlap or touch merge to
   the longest repeated passages, which are cut out.

Words are compared by 64-bit hashes, sequences of words by 64 bits beside the 64
of their anchor. Rows are told apart by two 64-bit hashes of their id and text.

Defined cases: a null text has no words. A text of fewer words than a window
keeps all. A very long text takes memory in proportion to itself in the task that
reads it, and its runs spread like any other. Ties cannot arise: every occurrence
of a repeated window goes. Rows with equal or null ids are told apart by their
texts; rows that are alike in both are one another's copies. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import content_key, discard, in_steps, stored, text_buffers, word_spans

#: Words of a window and of a seed.
WINDOW, SEED = 35, 8
_ODD_BYTE, _ODD_WORD, _ODD_SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Bytes that are hashed at once; a longer word is hashed by itself.
_BLOCK, _LONG_WORD = 1 << 18, 64
#: Bytes of texts in a step; the arrays over its words and bytes take some forty times as much.
_STEP = 1 << 20


@lru_cache(maxsize=8)
def _powers(odd: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def of(x: int) -> np.ndarray:
        out = np.full(size, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(odd), of(pow(odd, -1, 1 << 64))


def _powers_for(odd: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(odd, 1 << max(18, int(size).bit_length()))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(35).integers(1, 2**64, 256, np.uint64, endpoint=False)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _spans_hash(sums: np.ndarray, odd: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span [start, end), from running sums of value times power."""
    return _mixed((sums[ends] - sums[starts]) * _powers_for(odd, len(sums))[1][starts])


def _running(values: np.ndarray, odd: int) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers_for(odd, len(values))[0][: len(values)], out=sums[1:])
    return sums


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _BLOCK, "right")))
        a, b = int(starts[first]), int(ends[last - 1])
        if b - a <= _BLOCK:
            sums = _running(_byte_values()[data[a:b]], _ODD_BYTE)
            out[first:last] = _spans_hash(sums, _ODD_BYTE, starts[first:last] - a, ends[first:last] - a)
        first = last
    for i in np.flatnonzero(ends - starts > _LONG_WORD):  # long words need a hash without structure
        from xxhash import xxh64_intdigest

        out[i] = xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=35)
    return out


class _Words:
    """Words of a step of rows, with the sums that give any span's hash."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_buffers(column)
        self.starts, self.ends, self.at = word_spans(self.data, self.offsets)
        self.rows = len(self.offsets) - 1
        self.words = self.sums = self.second = None

    def hash(self) -> None:
        self.words = h = word_hashes(self.data, self.starts, self.ends)
        self.sums = _running(h, _ODD_WORD)
        self.second = _running(_mixed(h ^ np.uint64(_ODD_SECOND)), _ODD_SECOND)

    def runs(self, window: int, seed: int):
        """Of every run: the word it starts at, its number of windows, the words before its anchor, its anchor's hash and its own."""
        words, wide = len(self.starts), window - seed + 1
        n = words - window + 1
        none = np.empty(0, np.int64)
        if n <= 0:
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        grams = np.arange(words - seed + 1)
        least = _spans_hash(self.sums, _ODD_WORD, grams, grams + seed)
        place, size = grams, 1
        while size * 2 <= wide:
            less = least[size:] < least[:-size]
            least, place = np.where(less, least[size:], least[:-size]), np.where(less, place[size:], place[:-size])
            size *= 2
        less = least[wide - size : wide - size + n] < least[:n]
        place = np.where(less, place[wide - size : wide - size + n], place[:n])
        least = np.where(less, least[wide - size : wide - size + n], least[:n])
        # Windows that reach into the next row are none.
        row_end = np.repeat(self.at[1:], np.diff(self.at))
        real = np.arange(n) + window <= row_end[:n]
        first = real.copy()
        first[1:] &= (place[1:] != place[:-1]) | ~real[:-1]
        start = np.flatnonzero(first)
        # A run ends before the next run or the first window that is none.
        stop = np.flatnonzero(np.append(first[1:] | ~real[1:], True) & real) + 1
        # Runs are alike if their words are, and the anchor's place among them.
        own, before = _spans_hash(self.second, _ODD_SECOND, start, stop - 1 + window), place[start] - start
        return start, stop - start, before, least[start], _mixed(own + ((stop - start) * window + before).astype(np.uint64))

    def row_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, word, "right") - 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_RUN = "anchor long, own long, k1 long, k2 long, start int, n int, before int"


def _run_rows(window: int, seed: int):
    def run(batches):
        for batch in in_steps(batches, "text", _STEP):
            w = _Words(batch.column("text"))
            w.hash()
            start, n, before, anchor, own = w.runs(window, seed)
            row = w.row_of(start)
            k1, k2 = (batch.column(c).to_numpy()[row] for c in ("k1", "k2"))
            small = [pa.array(x.astype(np.int32)) for x in (start - w.at[row], n, before)]
            yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(own), pa.array(k1), pa.array(k2), *small], ["anchor", "own", "k1", "k2", "start", "n", "before"])

    return run


_CONTEXT = "anchor long, own long, most int, least int, left array<long>, right array<long>"


def _around(words: np.ndarray, first: np.ndarray, step: int, sizes: np.ndarray) -> pa.Array:
    """Lists of word hashes: ``sizes`` words from each of ``first``, in steps of 1 or -1."""
    ends = np.cumsum(sizes)
    at = np.repeat(first, sizes) + step * (np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), _signed(words[at]))


def _context_rows(window: int, seed: int):
    """The words around the anchors of the runs that a row lists, outwards, as far as the runs reach.

    ``most`` and ``least`` are the words that the first and the last window of a run have before the anchor.
    """

    def run(batches):
        last = None
        for batch in in_steps(batches, "text", _STEP):
            # Rows come in order of their keys: of a repeated row the first is enough.
            keys = [last, *zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)]
            last = keys[-1]
            batch = batch.filter(pa.array([x != y for x, y in zip(keys, keys[1:], strict=False)], pa.bool_()))
            w = _Words(batch.column("text"))
            w.hash()
            lists = batch.column("runs")
            row, flat = np.repeat(np.arange(w.rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()
            start, n, most = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "n", "before"))
            least, anchor = most - n + 1, w.at[row] + start + most
            left, right = _around(w.words, anchor - 1, -1, most), _around(w.words, anchor + seed, 1, window - seed - least)
            yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("own"), pa.array(most.astype(np.int32)), pa.array(least.astype(np.int32)), left, right], ["anchor", "own", "most", "least", "left", "right"])

    return run


def _extended(state: DataFrame) -> DataFrame:
    """Matches a step further on both sides.

    A row of ``state`` is an occurrence whose windows with ``a`` to ``b`` words
    before the anchor may repeat. All of these have ``a`` words on the left and
    on the right what windows with ``b`` on the left have; ``h`` is the hash of
    these words, ``left`` and ``right`` are the ones that follow. The windows
    with ``mid`` or more on the left share the words up to there; the others
    share as many more on the right.
    """
    a, b = F.col("a"), F.col("b")
    mid = F.expr("(a + b + 1) div 2").cast("int")
    size, other = b - mid, F.greatest(F.lit(0), mid - 1 - a)

    def side(lo, hi, h, left, right, there):
        return F.when(there & (F.col("most") >= lo) & (F.col("least") <= hi), F.struct(lo.alias("a"), hi.alias("b"), h.alias("h"), left.alias("left"), right.alias("right")))

    more_left = side(mid, b, F.xxhash64("h", F.lit(0), F.slice("left", F.lit(1), mid - a)), F.slice("left", mid - a + 1, size), F.slice("right", F.lit(1), size), a < b)
    more_right = side(a, mid - 1, F.xxhash64("h", F.lit(1), F.slice("right", F.lit(1), size + 1)), F.slice("left", F.lit(1), other), F.slice("right", size + 2, other), a < b)
    done = F.when(a == b, F.struct("a", "b", "h", "left", "right"))
    return state.select("anchor", "own", "most", "least", F.explode(F.array_compact(F.array(more_left, more_right, done))).alias("x")).select("anchor", "own", "most", "least", "x.*")


def repeated_windows(contexts: DataFrame, reach: int) -> DataFrame:
    """``anchor, own, mask``: which windows of a run also start in another run; bit i is the run's window i.

    ``contexts`` has the columns of ``_CONTEXT``, a row or more for each run of
    an anchor; ``reach`` is the number of words that a window has beside its anchor.
    A table that ``stored`` wrote is used up.
    """
    state = contexts.select("*", F.lit(0).alias("a"), F.lit(reach).alias("b"), F.lit(0).cast("long").alias("h"))
    held = contexts
    for _ in range(reach.bit_length()):  # the number of windows that a row stands for is halved each time
        kids = _extended(state)
        # An occurrence goes on where another run of the anchor has the same words.
        key = ["anchor", "a", "b", "h"]
        agreed = kids.groupBy(*key).agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo < hi").select(*key)
        agreed = stored(agreed, "substring-agreed")  # as above: the join can be split where one key is frequent
        state = stored(kids.join(agreed, key, "left_semi"), "substring-matches")
        discard(held, agreed)
        held = state
    return state.where("a = b").groupBy("anchor", "own").agg(F.bit_or(F.expr("shiftleft(1L, most - a)")).alias("mask"))


_KEPT = "doc_id long, n_words long, n_removed long, passages array<struct<first: long, last: long>>, kept string"


def _cut_rows(window: int):
    """Cut the marked windows out of every row."""
    passage = pa.struct([("first", pa.int64()), ("last", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("passages", pa.list_(passage)), ("kept", pa.string())])

    def run(batches):
        for batch in in_steps(batches, "text", _STEP):
            w = _Words(batch.column("text"))
            words = len(w.starts)
            lists = batch.column("marks")
            lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            row, flat = np.repeat(np.arange(w.rows), lengths), lists.flatten()
            start, mask = flat.field("start").to_numpy().astype(np.int64), flat.field("mask").to_numpy()
            hit, place = np.nonzero((mask[:, None] >> np.arange(window)) & 1)
            at = w.at[row[hit]] + start[hit] + place
            edge = np.zeros(words + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            # Passages: longest stretches of removed words inside a row.
            cut = np.zeros(words + 1, bool)
            cut[w.at] = True
            begin = gone & (np.append(True, ~gone[:-1])[:words] | cut[:-1]) if words else gone
            close = gone & (np.append(~gone[1:], True)[:words] | cut[1:]) if words else gone
            first, last = np.flatnonzero(begin), np.flatnonzero(close)
            of = w.row_of(first)
            spans = pa.StructArray.from_arrays([pa.array(first - w.at[of]), pa.array(last - w.at[of])], ["first", "last"])
            removed = np.append(0, np.cumsum(gone))
            # The kept words with one space between: word bytes, and the byte after each but a row's last.
            kept = np.flatnonzero(~gone)
            inner = kept[:-1][w.row_of(kept[:-1]) == w.row_of(kept[1:])] if len(kept) else kept
            step = np.zeros(len(w.data) + 1, np.int8)
            step[w.starts[kept]] += 1
            step[w.ends[kept]] -= 1
            take = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
            out = w.data.copy()
            out[w.ends[inner]], take[w.ends[inner]] = 32, True
            places = np.append(0, np.cumsum(take))[w.offsets].astype(np.int32)
            texts = pa.StringArray.from_buffers(w.rows, pa.py_buffer(places.tobytes()), pa.py_buffer(out[take].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(w.at)),
                    pa.array(np.diff(removed[w.at])),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(w.rows + 1)).astype(np.int32)), spans),
                    texts,
                ],
                schema=schema,
            )

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, passages, kept`` for every row: the removed passages (first and last word) and the text that is left."""
    if not 0 < seed < window < 63:
        raise ValueError("a seed is shorter than a window, and the windows of a run must fit a long")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    k1, k2 = content_key("doc_id", "text")
    rows = rows.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))

    # Seeds: runs whose anchor another run has as well.
    runs = stored(rows.select("k1", "k2", "text").mapInArrow(_run_rows(window, seed), _RUN), "substring-runs")
    shared = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    shared = stored(shared, "substring-shared")  # read from a table, both sides of the join can be split where an anchor is frequent
    seeds = stored(runs.join(shared, "anchor", "left_semi"), "substring-seeds")
    discard(runs, shared)

    # Extension: whole runs that repeat, and the words around one representative of each distinct run.
    distinct = seeds.groupBy("anchor", "own").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k1", "k2", "start", "n", "before")).alias("at"))
    distinct = stored(distinct.select("anchor", "own", "c", "at.*"), "substring-distinct")
    several = distinct.groupBy("anchor").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo < hi").select("anchor")
    several = stored(several, "substring-several")
    apart = distinct.join(several, "anchor", "left_semi")
    lists = apart.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", "before", "anchor", "own")).alias("runs"))
    contexts = rows.select("k1", "k2", "text").join(lists, ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(_context_rows(window, seed), _CONTEXT)
    marked = repeated_windows(stored(contexts, "substring-contexts"), window - seed)
    whole = distinct.where("c > 1").select("anchor", "own", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    masks = stored(whole.unionByName(marked).groupBy("anchor", "own").agg(F.bit_or("mask").alias("mask")), "substring-masks")
    discard(distinct, several)

    # Maximal repeats: what each row's marked windows cover.
    hits = seeds.join(masks, ["anchor", "own"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))
    hits = stored(hits, "substring-hits")
    discard(seeds, masks)
    return rows.join(hits, ["k1", "k2"], "left").select("doc_id", "text", "marks").mapInArrow(_cut_rows(window), _KEPT)
