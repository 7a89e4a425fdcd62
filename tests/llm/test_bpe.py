import hashlib
import random

import pytest

from loomwork.llm import bpe
from loomwork.llm.catalogue import QUERIES, default_tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return default_tokenizer()


@pytest.fixture(scope="module")
def reference():
    import base64

    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(rows, reference):
    out = []
    for i, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def run(docs, tokenizer, **chunks):
    return sorted(map(tuple, bpe.digests(bpe.encode(docs, tokenizer, **chunks), tokenizer).collect()), key=repr)


@pytest.mark.parametrize("chunks", [{}, {"chunk": 400, "overlap": 100}, {"chunk": 50, "overlap": 24}])
def test_odd_documents(docs_of, odd_rows, tokenizer, reference, chunks):
    assert run(docs_of(odd_rows), tokenizer, **chunks) == expected(odd_rows, reference)


def test_stitched_texts_of_many_kinds(docs_of, tokenizer, reference):
    rng = random.Random(7)
    bits = ["'s", "'ll", "don't", "  ", "\n\n \n", "123456", "１２", "naïve", "東京都", "😀", "!!!", "<|endoftext|>", "\x1c", "\x85", " ", "a" * 90, " x", "é", "٣", " " * 70]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 300))), "", "", 0) for i in range(60)]
    assert run(docs_of(rows), tokenizer, chunk=64, overlap=30) == expected(rows, reference)


@pytest.mark.parametrize("blank", ["\n\n", "\t\t", "  \n", "\n\n\n\n"])
def test_seam_right_after_white_space(docs_of, tokenizer, reference, blank):
    """The second chunk starts on the first character after a blank line."""
    rows = [(1, "x" * (34 - len(blank)) + blank + "word and more of it " * 5, "", "", 0)]
    assert run(docs_of(rows), tokenizer, chunk=64, overlap=30) == expected(rows, reference)


def test_decoding_gives_the_bytes(docs_of, odd_rows, tokenizer):
    encoded = bpe.encode(docs_of(odd_rows), tokenizer, chunk=1000, overlap=200)
    got = sorted(((r.doc_id, bytes(r.decoded)) for r in bpe.decode(encoded, tokenizer).collect()), key=repr)
    assert got == sorted(((i, (t or "").encode()) for i, t, *_ in odd_rows), key=repr)


def test_chunks_cover_a_text():
    for n in (0, 1, 9, 10, 11, 95, 100):
        text = "".join(chr(65 + i % 26) for i in range(n))
        parts = bpe.cut(text, 10, 3)
        assert "".join(c[0 if s == 0 else 3 :] for s, c in parts) == text and parts[-1][0] + len(parts[-1][1]) == n


def test_no_common_boundary_means_no_stitch():
    assert bpe.stitches([([0], [8, 9]), ([9, 12], [])]) == [0, 9]
    assert bpe.stitches([([0], [8]), ([9], [])]) is None


def test_chunks_must_hold_two_overlaps(docs_of, tokenizer):
    with pytest.raises(ValueError):
        bpe.encode(docs_of([]), tokenizer, chunk=10, overlap=5)


def test_empty_table(docs_of, tokenizer):
    assert run(docs_of([]), tokenizer) == []


def test_query(spark, sf_dir, reference):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op4_bpe"](spark, sf_dir).collect()), key=repr) == expected(rows, reference)


def test_long_text_without_latin_letters_stitches():
    rng = random.Random(4)
    signs = [chr(c) for c in range(0x4E00, 0x4F00)] + [chr(c) for c in range(0x3041, 0x3090)]
    tokenizer = default_tokenizer()
    for ends in ("，", "。\n", "！ "):
        text = "".join("".join(rng.choices(signs, k=rng.randint(5, 60))) + ends for _ in range(2500))
        parts = bpe.cut(text, bpe.CHUNK, bpe.OVERLAP)
        found = [bpe.seams(a, len(t), tokenizer.boundaries(t), k == len(parts) - 1, bpe.OVERLAP) for k, (a, t) in enumerate(parts)]
        places = bpe.stitches(found)
        assert len(parts) > 2 and places is not None
        ids = [i for a, b in zip(places, [*places[1:], None]) for i in tokenizer.encode(text[a:b])]
        assert ids == tokenizer.encode(text)
