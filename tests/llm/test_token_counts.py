import re
from collections import Counter

import pytest

from loomwork.llm import token_counts as tc
from loomwork.llm.catalogue import QUERIES, default_tokenizer


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, version, sign=1, tokenizer=None):
    out = Counter()
    for _, text, lang, source, _ in rows:
        n = len(tokenizer.encode(text or "")) if tokenizer else len(WORD.findall(text or ""))
        for m, x in (("n_docs", 1), ("n_tokens", n), ("n_bytes", len((text or "").encode()))):
            out[source, lang, version, m] += sign * x
    return out


def totals(store):
    return +Counter({(r.source, r.lang, r.tokenizer, m): r[m] for r in store.totals().collect() for m in tc.MEASURES})


def test_inserts_deletes_and_revisions(spark, docs_of, odd_rows, tmp_path):
    store, tokenizer = tc.Rollups(spark, str(tmp_path / "r")), default_tokenizer()
    assert store.totals().collect() == [] and store.committed() == set()
    docs = docs_of(odd_rows)
    words, pieces = tc.count_tokens(docs, "w", None), tc.count_tokens(docs, "p", tokenizer)
    assert store.commit("load", tc.inserts(words))
    assert totals(store) == +plain(odd_rows, "w")
    gone = [r for r in odd_rows if r[2] == "fr"]
    assert store.commit("drop", tc.deletes(tc.count_tokens(docs.where("lang = 'fr'"), "w", None)))
    left = plain(odd_rows, "w") + Counter()
    left.update(plain(gone, "w", -1))
    assert totals(store) == +left
    assert store.commit("revise", tc.revisions(words.where("lang <> 'fr' OR lang IS NULL"), pieces))
    assert totals(store) == +plain(odd_rows, "p", tokenizer=tokenizer)


def test_commits_are_idempotent(spark, docs_of, tmp_path):
    rows = [(1, "a b", "en", "s", 0), (2, None, None, None, None)]
    changes = tc.inserts(tc.count_tokens(docs_of(rows), "w", None))
    store = tc.Rollups(spark, str(tmp_path / "r"))
    assert store.commit("b-1", changes) and not store.commit("b-1", changes)
    once = totals(store)
    assert once == +plain(rows, "w")
    store.compact()
    assert totals(store) == once and store.committed() == {"b-1"}
    assert not store.commit("b-1", changes)
    assert store.commit("b-2", changes)
    assert totals(store) == Counter({k: 2 * v for k, v in once.items()})
    store.compact()
    assert totals(store) == Counter({k: 2 * v for k, v in once.items()}) and store.committed() == {"b-1", "b-2"}
    assert not store.commit("b-1", changes)  # its marker is gone by now, its name is not
    store.compact()
    assert totals(store) == Counter({k: 2 * v for k, v in once.items()}) and store._names("batches") == []
    assert len(store._names("rows")) <= 2 and store._names("aside") == []
    with pytest.raises(ValueError):
        store.commit("../x", changes)


class During(tc.Rollups):
    """A store in which something happens while rows are written."""

    then = None

    def _write(self, df):
        folder = super()._write(df)
        if self.then:
            act, self.then = self.then, None
            act()
        return folder


def test_two_writers_of_one_name(spark, docs_of, tmp_path):
    rows = [(1, "a b", "en", "s", 0)]
    changes = tc.inserts(tc.count_tokens(docs_of(rows), "w", None))
    first, second = During(spark, str(tmp_path / "r")), tc.Rollups(spark, str(tmp_path / "r"))
    won = []
    first.then = lambda: won.append(second.commit("b", changes))
    assert not first.commit("b", changes) and won == [True]
    assert totals(first) == +plain(rows, "w") and len(first._names("rows")) == 1
    # The other writer's batch has been folded in, and its marker removed, before this one has written.
    third = During(spark, str(tmp_path / "r"))
    third.then = lambda: [second.commit("c", changes), second.compact(), second.commit("d", changes), second.compact(), second.compact()]
    assert not third.commit("c", changes)
    assert totals(second) == Counter({k: 3 * v for k, v in plain(rows, "w").items()})


def test_commit_during_a_compaction_counts_once(spark, docs_of, tmp_path):
    rows = [(1, "a b", "en", "s", 0)]
    changes = tc.inserts(tc.count_tokens(docs_of(rows), "w", None))
    store, other = During(spark, str(tmp_path / "r")), tc.Rollups(spark, str(tmp_path / "r"))
    store.commit("a", changes)
    reader = other.totals()
    store.then = lambda: other.commit("b", changes)
    assert store.compact()
    assert totals(store) == Counter({k: 2 * v for k, v in plain(rows, "w").items()})
    assert sum(r.n_docs for r in reader.collect()) == 1  # a reader that began before still finds its files
    store.then = lambda: other.compact()
    assert not store.compact()
    assert totals(store) == Counter({k: 2 * v for k, v in plain(rows, "w").items()})


def test_empty_batch(spark, docs_of, tmp_path):
    store = tc.Rollups(spark, str(tmp_path / "r"))
    assert store.commit("none", tc.inserts(tc.count_tokens(docs_of([]), "w", None)))
    assert store.totals().collect() == []


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_bytes) for r in QUERIES["op7_token_counts"](spark, sf_dir).collect()}
    tokenizer, want = default_tokenizer(), Counter()
    for version, t in (("words-2", None), ("byte_bpe_50k", tokenizer)):
        want.update(plain(rows, version, tokenizer=t))
    keys = {k[:3] for k, v in want.items() if v}
    assert got == {k: tuple(want[(*k, m)] for m in tc.MEASURES) for k in keys}
