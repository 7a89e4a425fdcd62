import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomwork.llm import substring_dedup as sd
from loomwork.llm.catalogue import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    docs = [(i, WORD.findall(text or "")) for i, text, *_ in rows]
    seen = Counter(tuple(w[p : p + window]) for _, w in docs for p in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = {q for p in range(len(w) - window + 1) if seen[tuple(w[p : p + window])] > 1 for q in range(p, p + window)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def run(docs, window, seed):
    got = sd.substring_dedup(docs, window, seed)
    for r in got.collect():
        assert sum(p.last - p.first + 1 for p in r.passages) == r.n_removed
        assert all(a.last + 1 < b.first for a, b in zip(r.passages, r.passages[1:]))
    return sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)


def test_against_brute_force(docs_of):
    rng = random.Random(1)
    for words, window, seed in (("ab", 6, 2), ("abcdefgh", 5, 3), ("abcdefghijklmnopqrstuvwxyz", 12, 4)):
        rows = [(rng.randrange(40), rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randint(0, 40))), "", "", 0) for _ in range(50)]
        body = [rng.choice("xyz") + str(rng.randrange(50)) for _ in range(30)]
        rows += [(100 + i, " ".join(body[rng.randrange(10) : rng.randrange(20, 30)]), "", "", 0) for i in range(10)]
        assert run(docs_of(rows), window, seed) == brute(rows, window)


def test_odd_documents(docs_of, odd_rows):
    got = run(docs_of(odd_rows), sd.WINDOW, sd.SEED)
    assert got == brute(odd_rows, sd.WINDOW)
    assert sum(r[2] for r in got) > 500


def test_rows_without_id_whose_murmur_hashes_collide(spark, docs_of):
    """Two texts without an id that a 32-bit hash of the text can't tell apart stay two rows."""
    words = [F.concat(F.lit(f"w{k}x"), F.col("id").cast("string")) for k in range(12)]
    pairs = spark.range(200_000).select(F.concat_ws(" ", *words).alias("t")).groupBy(F.hash(F.lit(True), "t")).agg(F.collect_list("t").alias("ts")).where("size(ts) > 1").limit(3).collect()
    assert pairs
    rows = [(None, t, "en", "s", 0) for p in pairs for t in p.ts[:2]] + [(1, "x y " + pairs[0].ts[0], "en", "s", 0)]
    got = run(docs_of(rows), 6, 2)
    assert got == brute(rows, 6) and sum(r[2] for r in got) == 24


def test_repeated_rows(docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "en", "s", 0)] * 20 + [(1, text + " more", "en", "s", 0), (2, "some " + text[:150], "en", "s", 0), (2, "some " + text[:150], "en", "s", 0)]
    assert run(docs_of(rows), 35, 8) == brute(rows, 35)


def test_one_word_again_and_again(docs_of):
    rows = [(1, "a " * 500, "", "", 0), (2, "b " * 36, "", "", 0), (3, "c " * 35, "", "", 0)]
    assert run(docs_of(rows), 35, 8) == brute(rows, 35) == [(1, 500, 500, ""), (2, 36, 36, ""), (3, 35, 0, " ".join("c" * 35))]


def test_empty_table(docs_of):
    assert sd.substring_dedup(docs_of([])).collect() == []


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(sd, "_BLOCK", 16)
    text = "aa bbb aa " + "c" * 40 + " bbb é" + "d" * 100 + " " + "d" * 100
    w = sd._Words(pa.array([text, "aa é", None, "bbb"]))
    h = sd.word_hashes(w.data, w.starts, w.ends)
    names = text.split() + ["aa", "é", "bbb"]
    by_name = {}
    for name, x in zip(names, h.tolist(), strict=True):
        assert by_name.setdefault(name, x) == x
    assert len(set(by_name.values())) == len(by_name) and len(np.unique(h)) == len(by_name)


def test_query_matches_sql(same_as_sql):
    same_as_sql(QUERIES["op3_substring_dedup"], ORACLES["op3_substring_dedup"])
