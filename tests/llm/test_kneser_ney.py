import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomwork.llm import kneser_ney as kn
from loomwork.llm.catalogue import QUERIES


class Plain:
    """Interpolated modified Kneser-Ney by the book, for one language."""

    def __init__(self, texts, order):
        self.order, self.levels = order, {order: Counter()}
        for t in texts:
            s = kn._START * (order - 1) + " ".join((t or "").split())
            for i in range(len(s) - order + 1):
                self.levels[order][s[i : i + order]] += 1
        for n in range(order - 1, 0, -1):
            self.levels[n] = Counter(g[1:] for g in self.levels[n + 1])
        self.size = len(self.levels[1])
        self.d, self.contexts = {}, {}
        for n, level in self.levels.items():
            c = Counter(level.values())
            y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0.5
            self.d[n] = [min(max(i - (i + 1) * y * c[i + 1] / c[i] if c[i] else 0.5, 0.05), i - 0.05) for i in (1, 2, 3)]
            self.contexts[n] = defaultdict(list)
            for g, x in level.items():
                self.contexts[n][g[:-1]].append(x)

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / (self.size + 1)
        seen = self.contexts[n].get(gram[:-1])
        if not seen:
            return self.p(gram[1:])
        d = lambda x: self.d[n][min(x, 3) - 1]
        x = self.levels[n][gram]
        return ((x - d(x)) if x else 0) / sum(seen) + sum(map(d, seen)) / sum(seen) * self.p(gram[1:])

    def logs(self, text):
        s = kn._START * (self.order - 1) + " ".join((text or "").split())
        at = range(len(s) - self.order + 1)
        return sum(math.log(self.p(s[i : i + self.order])) for i in at), len(at)


TEXTS = {"en": ["the cat sat on the mat", "the hat", "", None, "a cat  at\nthe mat"], "日": ["東京都の猫 😀", "猫と猫"], None: ["abab abab"]}


@pytest.mark.parametrize("order,block,piece", [(2, 1 << 24, 1 << 20), (4, 30, 7), (6, 40, 1 << 20)])
def test_scores_against_the_book(spark, order, block, piece):
    """Whatever the blocks and the pieces that texts are cut into."""
    train = spark.createDataFrame([(a, t) for a, ts in TEXTS.items() for t in ts], "lang string, text string")
    model = kn.estimate(kn.counts(train, order), order)
    probes = ["the cat sat", "zebra the", "", None, "東京 猫", "abab b a", "x" * 50]
    docs = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate((a, t) for a in [*TEXTS, "xx"] for t in probes)], "i int, lang string, text string")
    got = {r.i: (r.logs, r.events) for r in kn.scored(docs, model, order, block, piece).collect()}
    plain = {a: Plain(ts, order) for a, ts in TEXTS.items()}
    for i, (a, t) in enumerate((a, t) for a in TEXTS for t in probes):
        logs, events = plain[a].logs(t)
        assert got[i][1] == events and math.isclose(got[i][0], logs, rel_tol=1e-9, abs_tol=1e-9), (a, t)


def test_probabilities_sum_to_one():
    plain = Plain(TEXTS["en"], 3)
    for context in ("th", "zz", "at"):
        known = [g for g in plain.levels[1]]
        total = sum(plain.p(context + c) for c in known) + plain.p(context + "\x00")
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_classes(spark, docs_of):
    rng = np.random.default_rng(0)
    words = "the and of cat dog house tree river stone light".split()
    good = [(i, " ".join(rng.choice(words, 60)), "en", "s", 0) for i in range(120)]
    bad = [(200 + i, "".join(rng.choice(list("qxzjk#%"), 200)), "en", "s", 0) for i in range(10)]
    odd = [(300, None, "en", "s", 0), (301, " \n", "en", "s", 0), (302, "no model here", "xx", "s", 0), (303, "nor here", None, "s", 0), (None, " ".join(words), "en", "s", 0), (304, "the cat " * 9000, "en", "s", 0)]
    rows = good + bad + odd + bad[:1]
    trusted = spark.createDataFrame([(i,) for i in range(0, 120)] + [(5,), (None,)], "doc_id long")
    got = kn.classify(docs_of(rows), trusted).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert sum(by[r[0]].kept for r in good) >= 115 and not any(by[r[0]].kept for r in bad)
    assert not by[300].kept and not by[301].kept and by[300].perplexity is None and by[302].kept and by[303].kept and by[302].threshold is None


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long")
    assert kn.classify(docs_of([]), none).collect() == []
    assert [r.kept for r in kn.classify(docs_of([(1, "a b", "en", "s", 0)]), none).collect()] == [True]


def test_order_is_bounded(docs_of):
    with pytest.raises(ValueError):
        kn.counts(docs_of([]), 7)


def test_query_separates_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality"](spark, folder)
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) >= 0.97 and sum(bad) / len(bad) <= 0.1
