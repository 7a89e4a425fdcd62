"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

For each language, n-grams of ``ORDER`` characters are counted in trusted text;
documents whose perplexity lies above a quantile of the trusted documents of
their language are of low quality.

1. Counts. Tasks count the n-grams of their own texts and send one row for each
   distinct n-gram; equal ones are summed by a shuffle on (language, n-gram). The
   n-grams of lower orders count by how many characters they follow
   (continuation counts), again one shuffle on their own key each.
2. Estimates. Discounts for counts of 1, 2 and 3 or more come from the counts of
   counts of each language and order. Each order's counts join their context's
   sums and the lower order's probabilities, sharded by n-gram: no order is ever
   gathered in one place. The result is a table with the logarithm of the
   interpolated probability of every n-gram seen, and of the back-off weight of
   every context.
3. Scores. Documents are packed, where they are read, into blocks of one language
   with the distinct n-grams of all orders that they hold: equal events of many
   documents become one request. Requests join the model table, sharded by n-gram,
   in a shuffle; what was found goes back to its block, and the block's texts are
   scored with that look-up alone. So neither the driver nor any task ever holds
   the model, and a block has a bounded number of characters. Blocks are scored in ``WAVES`` rounds, which bounds the disk. A frequent n-gram
   is one request of each block, and its partition can be split.
4. Thresholds. One trusted document in ``FOLDS`` (by a hash of its id) is left out
   of the training; the perplexities of these give, by language, the quantile
   above which a document goes. The quantile's rank is exact up to 100,000
   documents of a language and off by a hundred thousandth of them at most above.

The text that trains the model grows with the corpus, and so do the counts that
are gathered from it. N-grams of the model and of requests meet by 64-bit hashes
of language and characters.

Defined cases: null language is a language of its own. A null or empty text has
no events: its perplexity is null and it is not kept. In a language without
trusted text nothing can be judged: perplexity and threshold are null, and the
document is kept. A very long text is cut into pieces that overlap by a context,
and its sums are added up. Rows with equal ids are judged each, repeated rows too;
a document is trusted if any row of its id is. A perplexity equal to the threshold
passes. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import discard, in_steps, scratch, stored
from loomwork.llm.substring_dedup import _mixed

#: Characters of an n-gram, quantile of the trusted perplexities that still passes.
ORDER, QUANTILE = 4, 0.995
#: Characters of a block at which it is closed, and of a piece of it that is worked on at once.
BLOCK, PIECE = 16 << 20, 1 << 20
#: Rounds that blocks are scored in, so that a fourth of them is on the way at a time.
WAVES = 4
#: Before every text stand ORDER - 1 of these.
_START = "\x02"
#: One in so many trusted documents sets thresholds instead of training.
FOLDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str, order: int) -> np.ndarray:
    """Code points of a text after its start marks; white space is one space."""
    padded = _START * (order - 1) + " ".join(text.split())
    return np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)


def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of the ``n`` codes from every place where as many are left."""
    m = max(0, len(codes) - n + 1)
    key = np.full(m, n, np.uint64)
    for i in range(n):
        key = key * _BASE + codes[i : i + m].astype(np.uint64) + np.uint64(1)
    return key


def _count_rows(order: int):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("c", pa.int64())])

    def run(batches):
        for batch in in_steps(batches, "text", 8 << 20):
            by_lang: dict[str | None, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                codes = _codes(text or "", order)
                if len(codes) >= order:
                    # 21 bits for a code point: three fit a number, so an order of up to six is two numbers.
                    wide = np.zeros((2, len(codes) - order + 1), np.uint64)
                    for i in range(order):
                        wide[i // 3] = (wide[i // 3] << np.uint64(21)) | codes[i : i + wide.shape[1]].astype(np.uint64)
                    by_lang.setdefault(lang, []).append(wide)
            for lang, parts in by_lang.items():
                both = np.concatenate(parts, axis=1)
                at = np.lexsort(both)
                both = both[:, at]
                first = np.flatnonzero(np.append(True, (both[:, 1:] != both[:, :-1]).any(0)))
                counts = np.diff(np.append(first, both.shape[1]))
                split = [3, order - 3] if order > 3 else [order]
                letters = [(both[k, first] >> np.uint64(21 * (size - 1 - i))) & np.uint64((1 << 21) - 1) for k, size in enumerate(split) for i in range(size)]
                flat = np.stack(letters, 1).astype(np.uint32)
                joined = flat.tobytes().decode("utf-32-le", "surrogatepass")
                grams = [joined[i : i + order] for i in range(0, len(joined), order)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], schema=schema)

    return run


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, c``: how often every n-gram of ``order`` characters occurs in ``docs(lang, text)``."""
    if not 2 <= order <= 6:
        raise ValueError("the order is from 2 to 6")
    rows = docs.select("lang", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_count_rows(order), "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _discounts(grams: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3``: the modified discounts, from the counts of counts 1 to 4."""
    n = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in range(1, 5)]
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    # Small tables leave gaps in the counts of counts: a discount stays between 0 and its count.
    d = [F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5)))).alias(f"d{i}") for i in (1, 2, 3)]
    return grams.groupBy("lang").agg(*n).select("lang", *d)


def estimate(top: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, logp, logb`` for the n-grams of all orders that were seen.

    ``logp``: natural logarithm of the interpolated probability of the last
    character after those before it; ``logb``: of the back-off weight of the
    n-gram as a context. Either may be null.
    """
    with scratch(top.sparkSession) as kept:
        kept.append(stored(_estimated(top, order), "kn-model"))
    return kept[0]


def _estimated(top: DataFrame, order: int) -> DataFrame:
    level = stored(top, "kn-counts")
    levels = {order: level}
    for n in range(order - 1, 0, -1):
        shorter = levels[n + 1].select("lang", F.substring("gram", 2, n).alias("gram"))
        levels[n] = stored(shorter.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c")), "kn-counts")
    size = levels[1].groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    lower, found = None, []
    for n in range(1, order + 1):
        rows = levels[n].withColumn("context", F.substring("gram", 1, n - 1) if n > 1 else F.lit(""))
        d = _discounts(levels[n]).withColumnRenamed("lang", "dl")
        per = [F.sum("c").alias("total"), *[F.count_if(F.col("c") == i).alias(f"m{i}") for i in (1, 2)], F.count_if(F.col("c") >= 3).alias("m3")]
        contexts = rows.groupBy("lang", "context").agg(*per).join(d, F.col("lang").eqNullSafe(F.col("dl")))
        weight = (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total")
        contexts = stored(contexts.select(F.col("lang").alias("cl"), "context", "total", "d1", "d2", "d3", weight.alias("weight")), "kn-contexts")
        joined = rows.join(contexts.withColumnRenamed("context", "cc"), F.col("lang").eqNullSafe(F.col("cl")) & (F.col("context") == F.col("cc")))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = (F.col("c") - cut) / F.col("total")
        if n == 1:
            base = size.select(F.col("lang").alias("bl"), (1 / (F.col("v") + 1)).alias("below"))  # one place for all characters never seen
            joined = joined.join(base, F.col("lang").eqNullSafe(F.col("bl")))
        else:
            under = lower.select(F.col("lang").alias("bl"), F.col("gram").alias("bg"), "p").withColumnRenamed("p", "below")
            joined = joined.join(under, F.col("lang").eqNullSafe(F.col("bl")) & (F.substring("gram", 2, n - 1) == F.col("bg")))
        lower = stored(joined.select("lang", "gram", (own + F.col("weight") * F.col("below")).alias("p")), "kn-p")
        found.append((lower, contexts.select(F.col("cl").alias("lang"), F.col("context").alias("gram"), F.log("weight").alias("logb"))))
    # Never seen: the weight of the empty context, shared with one place more than there are characters.
    unseen = found[0][1].join(size.withColumnRenamed("lang", "sl"), F.col("lang").eqNullSafe(F.col("sl"))).select("lang", F.lit("").alias("gram"), (F.col("logb") - F.log(F.col("v") + 1)).alias("logp"), F.lit(None).cast("double").alias("logb"))
    every = unseen
    for p, b in found:
        every = every.unionByName(p.select("lang", "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("logb")))
        every = every.unionByName(b.where("gram <> ''").select("lang", "gram", F.lit(None).cast("double").alias("logp"), "logb"))
    return every.groupBy("lang", "gram").agg(F.max("logp").alias("logp"), F.max("logb").alias("logb"))


def _language(lang: str | None) -> np.uint64:
    from xxhash import xxh64_intdigest

    return np.uint64(0 if lang is None else xxh64_intdigest(lang.encode(), seed=1) | 1)


def _keyed(batches):
    """Rows (gram, logp, logb) with a 64-bit key for language and n-gram."""
    for batch in batches:
        grams, langs = batch.column("gram").to_pylist(), batch.column("lang").to_pylist()
        of = {lang: _language(lang) for lang in set(langs)}
        keys = np.zeros(len(grams), np.uint64)
        sizes = np.array([len(g) for g in grams])
        for n in set(sizes.tolist()) - {0}:
            at = np.flatnonzero(sizes == n)
            codes = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            key = np.full(len(at), n, np.uint64)
            for i in range(n):
                key = key * _BASE + codes[:, i].astype(np.uint64) + np.uint64(1)
            keys[at] = key
        keys = _mixed(keys ^ np.array([of[x] for x in langs], np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("logp"), batch.column("logb")], ["gram", "logp", "logb"])


class _Block:
    """Documents of one language: their rows, their characters in pieces, and the n-grams these hold."""

    def __init__(self, lang: str | None, order: int, piece: int):
        self.lang, self.order, self.piece, self.seed = lang, order, piece, _language(lang)
        self.rows, self.pieces, self.raw, self.sizes, self.owners, self.keys = [], [], [], [], [], [_mixed(np.zeros(1, np.uint64) ^ self.seed)]
        self.count = self.characters = 0

    def add(self, rows: pa.RecordBatch, texts: list[np.ndarray]) -> None:
        """``texts`` are the codes of the rows' texts."""
        step, overlap = self.piece, self.order - 1
        cut = [(i, t[a : a + step + overlap]) for i, t in enumerate(texts, self.count) for a in range(0, max(1, len(t) - overlap), step)]
        first, size = 0, 0
        for k, (_, part) in enumerate(cut, 1):
            size += len(part)
            if size >= step or k == len(cut):
                self._piece(cut[first:k])
                first, size = k, 0
        self.rows.append(rows)
        self.count += rows.num_rows

    def _piece(self, parts: list[tuple[int, np.ndarray]]) -> None:
        codes, sizes = np.concatenate([p for _, p in parts]), np.array([len(p) for _, p in parts])
        raw = codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        self.raw.append(len(raw))
        self.pieces.append(pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True))
        self.sizes.append(sizes)
        self.owners.append(np.array([i for i, _ in parts]))
        self.characters += len(codes)
        ends = np.repeat(np.cumsum(sizes), sizes)
        # The longest n-grams, each once; shorter ones are what these begin with, and the ends of the texts.
        start = np.arange(len(codes))
        for n in range(self.order, 0, -1):
            inside = start[(start + n) <= ends[start]]
            keys, at = np.unique(_rolled(codes, n)[inside], return_index=True)
            self.keys.append(_mixed(keys ^ self.seed))
            tails = np.flatnonzero(np.arange(len(codes)) + n > ends)
            start = np.union1d(inside[at], tails)

    def row(self, uid: int, names: list[str]) -> dict:
        table = pa.Table.from_batches(self.rows)
        rows = pa.StructArray.from_arrays([pa.concat_arrays(table.column(c).chunks) for c in names], names)
        keys = np.unique(np.concatenate(self.keys))
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        flat = lambda parts: one(pa.array(np.concatenate(parts).astype(np.int32)))
        ends = np.cumsum([len(x) for x in self.sizes]).astype(np.int32)
        return {"uid": pa.array([uid]), "lang": pa.array([self.lang], pa.string()), "rows": one(rows), "sizes": flat(self.sizes), "owners": flat(self.owners), "ends": one(pa.array(ends)), "raw": one(pa.array(self.raw, pa.int32())), "pieces": one(pa.array(self.pieces, pa.binary())), "keys": one(pa.array(keys.view(np.int64)))}


def _block_rows(order: int, names: list[str], block_size: int, piece: int):
    def run(batches):
        from pyspark import TaskContext

        held: dict[str | None, _Block] = {}
        uid = TaskContext.get().partitionId() << 32
        for batch in in_steps(batches, "text", piece):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            by_lang: dict = {}
            for i, lang in enumerate(langs):
                by_lang.setdefault(lang, []).append(i)
            for lang, rows in by_lang.items():
                block = held.setdefault(lang, _Block(lang, order, piece))
                block.add(batch.select(names).take(pa.array(rows)), [_codes(texts[i] or "", order) for i in rows])
                if block.characters >= block_size:
                    yield pa.RecordBatch.from_pydict(block.row(uid, names))
                    uid += 1
                    del held[lang]
            # Languages may be many: what is held stays bounded.
            if sum(b.characters for b in held.values()) >= 4 * block_size:
                lang = max(held, key=lambda x: held[x].characters)
                yield pa.RecordBatch.from_pydict(held.pop(lang).row(uid, names))
                uid += 1
        for block in held.values():
            yield pa.RecordBatch.from_pydict(block.row(uid, names))
            uid += 1

    return run


class _Found:
    """What the model has of a block's n-grams."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray, logb: np.ndarray, seed: np.uint64):
        at = np.argsort(keys)
        self.keys, self.logp, self.logb, self.seed = keys[at], logp[at], logb[at], seed

    def look_up(self, values: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The values of n-grams; NaN where one is missing."""
        if not len(self.keys):
            return np.full(len(grams), np.nan)
        keys = _mixed(grams ^ self.seed)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, values[at], np.nan)


def event_logs(found: _Found, codes: np.ndarray, order: int, at: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of the events that end at the places ``at`` of ``codes``."""
    total, open_ = np.zeros(len(at)), np.arange(len(at))
    for n in range(order, 0, -1):
        logs = found.look_up(found.logp, _rolled(codes, n)[at[open_] - n + 1])
        hit = ~np.isnan(logs)
        total[open_[hit]] += logs[hit]
        open_ = open_[~hit]
        if not len(open_):
            return total
        if n > 1:  # the context's weight, if it was ever seen
            total[open_] += np.nan_to_num(found.look_up(found.logb, _rolled(codes, n - 1)[at[open_] - n + 1]))
    total[open_] += found.look_up(found.logp, np.zeros(1, np.uint64))[0]
    return total


def _score_rows(order: int, names: list[str]):
    """Rows of a block with the sums of their events, by what was found for the block."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, pieces = batch.column("rows")[k].values, batch.column("pieces")[k].values
                sizes, owners, ends, raw = (batch.column(c)[k].values.to_numpy() for c in ("sizes", "owners", "ends", "raw"))
                logs, events = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
                known = batch.column("found")[k].values
                if known is not None and len(known):  # else the language has no model
                    keys, logp, logb = (known.field(c).to_numpy(zero_copy_only=False) for c in ("gram", "logp", "logb"))
                    found = _Found(keys.view(np.uint64), logp.astype(float), logb.astype(float), _language(batch.column("lang")[k].as_py()))
                    for i, b in enumerate(ends.tolist()):
                        a = int(ends[i - 1]) if i else 0
                        total = int(sizes[a:b].sum())
                        text = pa.decompress(pieces[i].as_buffer(), int(raw[i]), "zstd", asbytes=True).decode("utf-8", "surrogatepass")
                        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                        row = np.repeat(owners[a:b], sizes[a:b])
                        begin = np.repeat(np.cumsum(sizes[a:b]) - sizes[a:b], sizes[a:b])
                        at = np.flatnonzero(np.arange(total) - begin >= order - 1)
                        logs += np.bincount(row[at], event_logs(found, codes, order, at), len(logs))
                        events += np.bincount(row[at], minlength=len(events))
                yield pa.RecordBatch.from_arrays([*[rows.field(c) for c in names], pa.array(logs), pa.array(events)], [*names, "logs", "events"])

    return run


def scored(docs: DataFrame, model: DataFrame, order: int = ORDER, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """The columns of ``docs(lang, text, ...)`` but the text, with ``logs`` (natural logarithms summed) and ``events`` (characters scored)."""
    names = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    inner = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    kind = f"uid long, lang string, rows array<struct<{inner}>>, sizes array<int>, owners array<int>, ends array<int>, raw array<int>, pieces array<binary>, keys array<long>"
    with scratch(docs.sparkSession) as kept:
        table = stored(model.select("lang", "gram", "logp", "logb").mapInArrow(_keyed, "gram long, logp double, logb double"), "kn-keyed")
        blocks = stored(docs.mapInArrow(_block_rows(order, names, block, piece), kind), "kn-blocks")
        for wave in range(WAVES):
            some = blocks.where(F.pmod(F.xxhash64("uid"), F.lit(WAVES)) == wave)
            asked = some.select("uid", F.explode("keys").alias("gram"))
            found = asked.join(table.hint("merge"), "gram").groupBy("uid").agg(F.collect_list(F.struct("gram", "logp", "logb")).alias("found"))
            found = stored(found, "kn-found")
            texts = some.select("uid", "lang", "rows", "sizes", "owners", "ends", "raw", "pieces")
            sums = texts.join(found, "uid", "left").drop("uid").mapInArrow(_score_rows(order, names), f"{fields}, logs double, events long")
            kept.append(stored(sums, "kn-sums"))
            discard(found)
    return reduce(DataFrame.unionByName, kept)


def classify(docs: DataFrame, trusted: DataFrame, order: int = ORDER, quantile: float = QUANTILE, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``doc_id, lang, n_events, perplexity, threshold, kept`` for every row of ``docs``; ``trusted`` has the ids of trusted documents."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    rows = rows.withColumn("empty", ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))
    ids = trusted.select(F.col(id_column).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    aside = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)) == 0
    # A merge join whatever the number of ids, so that a small table takes the way that a large one has to.
    learned = rows.join(ids.where(~aside).hint("merge"), "doc_id", "left_semi").select("lang", "text")
    model = estimate(counts(learned, order), order)
    sums = scored(rows, model, order)
    discard(model)
    perplexity = F.when((F.col("events") > 0) & (F.col("logs") < 0), F.exp(-F.col("logs") / F.col("events")))
    found = sums.select("doc_id", "lang", "empty", F.col("events").alias("n_events"), perplexity.alias("perplexity"))
    judged = found.join(ids.where(aside), "doc_id", "left_semi").where("perplexity IS NOT NULL")
    limits = judged.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, F.lit(100_000)).alias("threshold")).withColumnRenamed("lang", "ll")
    with_limit = found.join(limits, F.col("lang").eqNullSafe(F.col("ll")), "left").drop("ll")
    # Without a perplexity a row is empty and goes, or of a language without trusted text and stays.
    kept = ~F.col("empty") & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return with_limit.select("doc_id", "lang", "n_events", "perplexity", "threshold", kept.alias("kept"))
