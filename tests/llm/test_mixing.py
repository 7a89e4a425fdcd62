import math
import re
from collections import defaultdict

from loomwork.llm import mixing
from loomwork.llm.catalogue import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """Source sizes to targets, by the rule as it is stated."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        rest = total - sum(cap * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in order}
        full |= above


def check(rows, got, close):
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken = plain_targets(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        taken[r.source] += r.size * r.copies
        assert 0 <= r.copies <= 3 and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= close * max(t, 1), (s, taken[s], t)


def test_targets_and_copies(docs_of):
    rows = [(i, "w " * (1 + i * 7 % 90), "en", f"s{i % 5}", 0) for i in range(400)]
    rows += [(1000 + i, "w " * 20, "en", "tiny", 0) for i in range(3)]  # stops at three times its size
    rows += [(2000 + i, "w " * (1 + i % 9), "en", None, 0) for i in range(200)]
    check(rows, mixing.mix(docs_of(rows)).collect(), 0.01)


def test_skewed_sizes_in_one_source(docs_of):
    rows = [(i, "w " * (5000 if i % 50 == 0 else 10), "en", "ab"[i % 2], 0) for i in range(300)] + [(900 + i, "w " * 50, "en", "c", 0) for i in range(60)]
    check(rows, mixing.mix(docs_of(rows)).collect(), 0.05)


def test_reruns_agree(docs_of):
    rows = [(i, "w " * (i % 30), "en", f"s{i % 4}", 0) for i in range(200)]
    one, two = (sorted(map(tuple, mixing.mix(docs_of(rows).repartition(n)).collect())) for n in (1, 7))
    assert one == two


def test_odd_documents(docs_of, odd_rows):
    got = mixing.mix(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.copies <= 3 for r in got)
    empty = [(1, None, "", "a", 0), (2, " ", "", None, 0)]
    assert sorted((r.doc_id, r.size, r.target, r.size * r.copies) for r in mixing.mix(docs_of(empty)).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_empty_table(docs_of):
    assert mixing.mix(docs_of([])).collect() == []


def test_repeated_rows(docs_of):
    rows = [(1, "a b c", "", "x", 0)] * 50 + [(2, "a b", "", "y", 0)] * 50
    check(rows, mixing.mix(docs_of(rows)).collect(), 0.9)


def test_rates_meet_the_dual(docs_of):
    """At the solution the rates of a source that isn't full sum to its target, and their log odds are linear in size."""
    rows = [(i, "w " * (1 + i % 40), "en", "abc"[i % 3], 0) for i in range(300)]
    got = mixing.mix(docs_of(rows)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for members in by.values():
        assert math.isclose(sum(r.rate * r.size for r in members), members[0].target, rel_tol=1e-5)
        slopes = [math.log(r.rate / (3 - r.rate) * 2) / r.size for r in members if 0 < r.rate < 3]
        assert max(slopes) - min(slopes) < 1e-6


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = QUERIES["op5_mixing"](spark, folder)
    assert dict(got.dtypes)["taken"] == "bigint" and dict(got.dtypes)["target"] == "double"
    check(rows, got.collect(), 0.01)
