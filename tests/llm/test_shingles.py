import random

import pytest
from test_simhash import LOWER, WORD

import corpus_pipeline
from loomwork.llm import shingles

NEAR_STAGE = dict(corpus_pipeline.STAGES)["simhash_dedup"]


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return bool(a) and 5 * len(a & b) >= 4 * len(a | b)


def groups(texts):
    """For each text the first place of its component."""
    every, label = [shingle_set(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if label[a] != label[b] and similar(every[a], every[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


def near_texts(rng):
    texts = [None, "", " ", "one", "One", "two words", "a b c d e", "a b c d e"]
    for _ in range(6):
        body = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 150))]
        for _ in range(8):
            changed = list(body)
            for _ in range(rng.randrange(5)):
                changed[rng.randrange(len(body))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(changed[rng.randrange(4) :]))
    return texts


def test_components_against_brute_force(spark):
    texts = near_texts(random.Random(12))
    df = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    label, want = list(range(len(texts))), groups(texts)
    for e in shingles.near_links(df).collect():
        old, new = max(label[e.a], label[e.b]), min(label[e.a], label[e.b])
        label = [new if x == old else x for x in label]
    assert label == want and len(set(want)) < len(texts) - 10


@pytest.mark.parametrize("sf", ["documents", "made"])
def test_stage_leaves_no_near_copies(spark, docs_of, sf_dir, sf):
    if sf == "documents":
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    else:
        docs = docs_of([(i, t, "en", "s", 0) for i, t in enumerate(near_texts(random.Random(13)))])
    left = [shingle_set(r.text) for r in NEAR_STAGE(spark, docs, sf_dir).collect()]
    assert len(left) > 5
    assert not [1 for a in range(len(left)) for b in range(a) if similar(left[a], left[b])]


def test_texts_that_share_a_passage_are_not_compared_in_pairs(spark, monkeypatch):
    """A passage of three quarters of eighty texts makes no pairs of them; near copies among them are found."""
    rng = random.Random(14)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([*passage, *(f"o{i}-{k}" for k in range(20))]) for i in range(80)]
    texts += [" ".join([*t.split()[:-1], "changed"]) for t in texts[:5]]
    rng.shuffle(texts)
    compared, verified = [], shingles._verified
    monkeypatch.setattr(shingles, "_verified", lambda pairs, *also: compared.append(pairs.count()) or verified(pairs, *also))
    found = shingles.near_links(spark.createDataFrame(list(enumerate(texts)), "_row long, text string")).collect()
    label, want = list(range(len(texts))), groups(texts)
    for e in found:
        label[max(e.a, e.b)] = min(e.a, e.b)
    assert label == want and len(set(want)) == 80
    assert sum(compared) < 2 * len(texts)
