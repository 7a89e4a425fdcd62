"""The pipeline's stages against plain versions of what they decide."""

import hashlib
import pathlib
import re
from collections import Counter, defaultdict

import pytest
from test_line_dedup import brute as line_brute
from test_mixing import plain_targets
from test_simhash import brute as simhash_brute

import corpus_pipeline
from loomwork.llm import catalogue, stages
from loomwork.llm.shared import clear_stored, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mix_sources", "bpe_encode"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage_drops_texts_without_letters_only(spark, docs_of, odd_rows):
    got = stages.language_id(spark, docs_of(odd_rows), "")
    assert got.columns == COLUMNS
    want = [r for r in odd_rows if r[1] and any(c.isalpha() for c in r[1])]
    assert Counter(r[:2] for r in rows_of(got)) == Counter(r[:2] for r in want)
    assert {r[2] for r in rows_of(got)} <= {r[2] for r in odd_rows}


def test_line_stage(spark, docs_of, documents):
    rows = documents[:60]
    got = stages.line_dedup(spark, docs_of(rows), "")
    assert got.columns == COLUMNS
    own = {r[0]: r for r in rows}
    want = [(i, kept, own[i][2], own[i][3], len(kept)) for i, _, removed, _, kept in line_brute(rows) if not removed or kept.strip()]
    assert rows_of(got) == sorted(want, key=repr)


def test_line_stage_odd_documents(spark, docs_of, odd_rows):
    got = rows_of(stages.line_dedup(spark, docs_of(odd_rows), ""))
    assert {r[0] for r in got} == {r[0] for r in odd_rows} and all(r[1] is not None for r in got)


@pytest.mark.parametrize("which", ["documents", "odd_rows"])
def test_simhash_stage_keeps_one_of_each_component(spark, docs_of, request, which):
    rows = request.getfixturevalue(which)
    got = rows_of(stages.simhash_dedup(spark, docs_of(rows), ""))
    # Components of row numbers, as ids may repeat or be null; of each the smallest id stays, null last.
    numbered = [(n, r[1]) for n, r in enumerate(rows)]
    members = defaultdict(list)
    for n, _, component in simhash_brute(numbered):
        members[component].append(n)
    assert len(got) == len(members)
    least = lambda ns: min(((rows[n][0] is None, rows[n][0] or 0) for n in ns))
    assert Counter((r[0] is None, r[0] or 0) for r in got) == Counter(map(least, members.values()))
    assert set(got) <= set(rows)


def test_mix_stage_repeats_and_drops_documents(spark, docs_of, documents):
    got = rows_of(stages.mix_sources(spark, docs_of(documents), ""))
    copies = Counter(got)
    assert set(copies) <= set(documents) and max(copies.values()) <= 3
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in documents:
        sizes[r[3]] += len(WORD.findall(r[1]))
    for r in got:
        taken[r[3]] += len(WORD.findall(r[1]))
    for source, target in plain_targets(sizes).items():
        smallest = min(len(WORD.findall(r[1])) for r in documents if r[3] == source)
        assert abs(taken[source] - target) <= max(0.05 * target, 2 * smallest), source


def test_mix_stage_does_not_depend_on_how_rows_are_dealt(spark, docs_of, documents, odd_rows):
    rows = documents[:80] + odd_rows
    one, seven = (Counter(rows_of(stages.mix_sources(spark, docs_of(rows).repartition(n), ""))) for n in (1, 7))
    assert one == seven


def test_mix_stage_odd_documents(spark, docs_of, odd_rows):
    got = rows_of(stages.mix_sources(spark, docs_of(odd_rows), ""))
    copies = Counter(got)
    assert set(copies) <= set(odd_rows)
    own = Counter(odd_rows)
    for r in set(odd_rows):
        assert copies[r] <= 3 * own[r]
        if not WORD.search(r[1] or ""):
            assert copies[r] == own[r]  # weighs nothing and stays


def test_bpe_stage_odd_documents(spark, docs_of, odd_rows):
    tokenizer = catalogue.default_tokenizer()
    got = stages.bpe_encode(spark, docs_of(odd_rows), "").collect()
    want = [(i, len(tokenizer.encode(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in odd_rows]
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == Counter(want)


def test_stages_take_empty_tables(spark, docs_of, sf_dir):
    docs = docs_of([])
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"empty-{name}")
        assert docs.count() == 0


def test_whole_pipeline(spark, sf_dir, documents):
    clear_stored(spark)
    done = corpus_pipeline.run(spark, sf_dir)
    left = list(pathlib.Path(spark.conf.get("spark.checkpoint.dir")).glob("loomwork-*/*"))
    assert [x.name.rpartition("-")[0] for x in left] == ["pipeline-bpe_encode"]  # nothing else stays behind
    got = done.collect()
    assert 0.5 * len(documents) < len(got) < 3 * len(documents)
    counts = Counter(r.doc_id for r in got)
    assert max(counts.values()) <= 3 and set(counts) <= {r[0] for r in documents}
    # A document that no stage changed decodes to its own text.
    own = {r[0]: hashlib.sha256(r[1].encode()).hexdigest() for r in documents}
    assert sum(r.decoded_sha256 == own[r.doc_id] for r in got) > 0.3 * len(got)
