import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomwork.llm import langid
from loomwork.llm.catalogue import QUERIES

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and the cat sat on the mat with another hat",
    "de": "der schnelle braune fuchs springt über den faulen hund und die katze sitzt auf der matte",
    "fr": "le renard brun rapide saute par dessus le chien paresseux et le chat est sur le tapis",
    "es": "el rápido zorro marrón salta sobre el perro perezoso y el gato está en la alfombra",
    "xx": "qwzrk plonk vrrt zzyx qopl kkrt wwzq plzk vrqq zonk",
}


def labelled(n):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for lang, text in SAMPLES.items():
        words = text.split()
        for _ in range(n):
            rows.append((i, " ".join(rng.choice(words, 25)), lang, "s", 0))
            i += 1
    return rows


def run(docs, model):
    return {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model, "text", "doc_id").collect()}


def test_families_then_languages(docs_of):
    docs = docs_of(labelled(30))
    model = langid.train(docs)
    assert {a for a, *_ in model.machines} == {"family", "germanic", "romance"} and model.languages == sorted(SAMPLES)
    new = [(i, " ".join(reversed(t.split())).upper(), None, None, None) for i, t in enumerate(SAMPLES.values())]
    got = run(docs_of(new), model)
    assert [got[i][0] for i in range(len(new))] == list(SAMPLES) and all(0 <= s <= 1 for _, s in got.values())


def test_odd_documents(docs_of, odd_rows):
    got = langid.predict(docs_of(odd_rows), langid.train(docs_of(labelled(20))), "text", "doc_id").collect()
    assert len(got) == len(odd_rows)
    none = {1, 2, 3, 7}
    for r in got:
        if r.doc_id in none:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in SAMPLES and 0 <= r.score <= 1


def test_without_labels_and_with_one_language(docs_of):
    rows = [(1, "some text", None, "s", 0), (2, "123", None, "s", 0)]
    assert run(docs_of(rows), langid.train(docs_of(rows))) == {1: ("und", 0.0), 2: ("und", 0.0)}
    one = langid.train(docs_of([(5, "hello", "en", "s", 0)]))
    assert run(docs_of(rows), one) == {1: ("en", 1.0), 2: ("und", 0.0)}


def test_empty_table(docs_of):
    model = langid.train(docs_of([]))
    assert model.languages == [] and run(docs_of([]), model) == {}


def test_the_sample_is_bounded(docs_of):
    docs = docs_of([(i, "the cat", "en", "s", 0) for i in range(2000)])
    place = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    assert 20 < docs.where(place < 50 / 2000).count() < 100


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 3]) + 0.3 > 0, 1.0, -1.0)
    w = langid.train_svm(x, y, penalty=100.0)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.98


def test_features_ignore_rows_beside(docs_of):
    texts = ["the cat", None, "über", "a", ""]
    together = langid.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], langid.features(pa.array([t], pa.string()))[0])


def test_held_out(docs_of):
    rows = [(i, "x", "en", "s", 0) for i in range(50)] + [(None, "x", "en", "s", 0)]
    got = docs_of(rows).select("doc_id", langid.held_out("doc_id").alias("out")).collect()
    assert all(r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_query_is_right_on_held_out_documents(spark, sf_dir):
    got = QUERIES["op8_language_id"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95


def test_languages_under_repeated_ids_are_all_learned(spark, docs_of):
    en = ["the house of the king", "and the river was wide", "with all that they had"]
    fr = ["la maison du roi était", "et la rivière est grande", "avec tout ce que nous avons"]
    rows = [(1, f"{en[i % 3]} {i}", "en", "s", 0) for i in range(1500)] + [(3, f"{fr[i % 3]} {i}", "fr", "s", 0) for i in range(1500)]
    rows += [(4, "el perro y el gato", "es", "s", 0)] * 500
    got = Counter(r.lang for r in langid.sample(docs_of(rows), per_language=100).collect())
    assert got["es"] == 1 and 60 <= got["en"] <= 100 and 60 <= got["fr"] <= 100
    model = langid.train(docs_of(rows), per_language=100)
    assert model.languages == ["en", "es", "fr"]
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs_of(rows), model, "text", "doc_id").collect()}
    assert found == {1: "en", 3: "fr", 4: "es"}
