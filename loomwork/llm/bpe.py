"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of at most ``chunk`` characters is encoded as it stands. A longer one is
cut into chunks that overlap by ``overlap`` characters, and the chunks are dealt
over all tasks:

1. every chunk is pre-tokenised from its own start, as if the text began there;
2. two neighbours are stitched at the first place inside their overlap where
   both have a pre-token boundary. The pattern only looks ahead, so from a
   common boundary on both cut alike; matches that the end of a chunk may have
   cut short are left out of account, and so are boundaries after white space:
   a run of it is cut otherwise where a piece ends. Characters beside a boundary
   must be of one class in all versions of Unicode from 3.2 on, whatever the script.
   Where two neighbours have no such place (one pre-token longer than the overlap),
   the text is encoded whole;
3. the pieces between stitches are encoded, each by itself, in parallel, and
   the ids of a text are put in order again.

Decoding concatenates the raw bytes of the ids. No id is special; strings such
as an end-of-text mark are ordinary text.

Defined cases: a null text counts as empty and has no ids. Rows with equal or
null ids stay apart: a long text is known by a number that its chunks were
written with. Repeated rows are encoded each. A very long text is dealt over
tasks in chunks; only its ids, and its text where it can't be stitched, meet in one
task again. Ties cannot arise. Other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import in_steps, stored

#: Characters of a chunk, and by how many neighbours overlap.
CHUNK, OVERLAP = 32768, 2048

_CHUNK_ROWS = "uid long, doc_id long, part int, start long, length long, last boolean, content string"
_SEAM_ROWS = "uid long, doc_id long, part int, start long, head array<long>, tail array<long>"


@lru_cache(maxsize=4)
def _tables(ranks: bytes, pattern: str):
    """The encoding and, by id, its bytes and its decimal digits."""
    import tiktoken

    by_bytes = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=by_bytes, special_tokens={})
    raw = [b""] * (max(by_bytes.values(), default=-1) + 1)
    for token, rank in by_bytes.items():
        raw[rank] = token
    return encoding, raw, [b"%d" % i for i in range(len(raw))]


@lru_cache(maxsize=4)
def _boundary_pattern(pattern: str):
    import regex

    return regex.compile(pattern)


@lru_cache(maxsize=1 << 16)
def _plain(c: str) -> bool:
    """Whether every Unicode version from 3.2 on classes a character alike: letter, number, separator or other."""
    if c < "\u0250":
        return not "\x1c" <= c <= "\x1f"
    kind = unicodedata.ucd_3_2_0.category(c)
    of = lambda x: x[0] if x[0] in "LNZ" else "other"
    return kind != "Cn" and of(kind) == of(unicodedata.category(c))


class Tokenizer:
    """A byte-level BPE vocabulary: the content of a ranks file and the pre-token pattern.

    The file is read once, by the driver; tasks get its content (a vocabulary
    has a fixed size, about 1 MB here), so executors need no copy of the file.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = f.read()
        self.pattern = pattern

    def encode(self, text: str) -> list[int]:
        return _tables(self.ranks, self.pattern)[0].encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return b"".join(map(_tables(self.ranks, self.pattern)[1].__getitem__, ids))

    def boundaries(self, text: str) -> list[int]:
        """Starts of pre-tokens between two characters that every Unicode version classes alike, the first no white space.

        White space that ends a piece has nothing after it to look ahead to, and would be one pre-token.
        """
        starts = (m.start() for m in _boundary_pattern(self.pattern).finditer(text))
        return [b for b in starts if _plain(text[b]) and (b == 0 or (_plain(text[b - 1]) and not text[b - 1].isspace()))]

    def digits(self, ids) -> bytes:
        return b" ".join(map(_tables(self.ranks, self.pattern)[2].__getitem__, ids))


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """Overlapping chunks ``(start, content)`` that cover a text."""
    starts = range(0, max(1, len(text) - overlap), chunk - overlap)
    return [(a, text[a : a + chunk]) for a in starts]


def seams(start: int, length: int, found: list[int], last: bool, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk, as places in the text, in the overlap with the chunk before and with the one after.

    In a chunk that does not end the text the last two boundaries are left out:
    what the pattern would do there can depend on what follows.
    """
    held = found if last else found[:-2]
    head = [start + b for b in held if b <= overlap]
    tail = [] if last else [start + b for b in held if b >= length - overlap]
    return head, tail


def stitches(parts: list[tuple[list[int], list[int]]]) -> list[int] | None:
    """Where the pieces begin, from ``(head, tail)`` of the chunks in order; None if two neighbours share no boundary."""
    places = [0]
    for (_, tail), (head, _) in zip(parts, parts[1:], strict=False):
        common = set(tail).intersection(head)
        if not common:
            return None
        places.append(min(common))
    return places


def _cut_rows(chunk: int, overlap: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                parts = cut(row["text"], chunk, overlap)
                for i, (start, content) in enumerate(parts):
                    yield pa.RecordBatch.from_pydict(
                        {"uid": [row["uid"]], "doc_id": [row["doc_id"]], "part": [i], "start": [start], "length": [len(content)], "last": [i == len(parts) - 1], "content": [content]},
                        pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("last", pa.bool_()), ("content", pa.string())]),
                    )

    return run


def _seam_rows(tokenizer: Tokenizer, overlap: int):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = [seams(x["start"], x["length"], tokenizer.boundaries(x["content"]), x["last"], overlap) for x in rows]
            yield pa.RecordBatch.from_pydict(
                {**{c: [x[c] for x in rows] for c in ("uid", "doc_id", "part", "start")}, "head": [x[0] for x in found], "tail": [x[1] for x in found]},
                pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))]),
            )

    return run


def _stitch(rows):
    """The pieces of one text; ``whole`` where its chunks can't all be stitched."""
    rows = rows.sort_values("part")
    places = stitches([(list(h), list(t)) for h, t in zip(rows["head"], rows["tail"], strict=True)])
    out = rows[["uid", "part"]].copy()
    out["whole"] = places is None
    begin = places or [0] * len(rows)
    out["first"] = [b - s for b, s in zip(begin, rows["start"], strict=True)]
    out["end"] = [*(b - s for b, s in zip(begin[1:], rows["start"], strict=False)), -1]
    return out


def _encode_pieces(tokenizer: Tokenizer):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            ids = [np.array(tokenizer.encode(x["content"][x["first"] : x["end"] if x["end"] >= 0 else None]), np.int32).tobytes() for x in rows]
            yield pa.RecordBatch.from_pydict(
                {"uid": [x["uid"] for x in rows], "doc_id": [x["doc_id"] for x in rows], "part": [x["part"] for x in rows], "ids": ids},
                pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("ids", pa.binary())]),
            )

    return run


def _first_id(rows):
    return None if rows["doc_id"].isna().any() else int(rows["doc_id"].iloc[0])


def _join_pieces(rows):
    import pandas as pd

    rows = rows.sort_values("part")
    return pd.DataFrame({"doc_id": pd.array([_first_id(rows)], "Int64"), "ids": [b"".join(rows["ids"])]})


def _encode_whole(tokenizer: Tokenizer):
    def run(rows):
        import pandas as pd

        rows = rows.sort_values("part")
        ends = [*rows["start"].iloc[1:], None]
        text = "".join(c[: None if e is None else e - s] for c, s, e in zip(rows["content"], rows["start"], ends, strict=True))
        return pd.DataFrame({"doc_id": pd.array([_first_id(rows)], "Int64"), "ids": [np.array(tokenizer.encode(text), np.int32).tobytes()]})

    return run


def _encode_short(tokenizer: Tokenizer):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in in_steps(batches, "text"):
            ids = [np.array(tokenizer.encode(t or ""), np.int32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return run


def encode(docs: DataFrame, tokenizer: Tokenizer, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id long, ids binary`` (little-endian int32) for every row of ``docs``."""
    if not 0 < 2 * overlap < chunk:
        raise ValueError("a chunk must be longer than two overlaps, else a stitch could rest on unchecked boundaries")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = rows.where(~is_long).mapInArrow(_encode_short(tokenizer), "doc_id long, ids binary")
    chunks = rows.where(is_long).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_cut_rows(chunk, overlap), _CHUNK_ROWS)
    chunks = stored(chunks, "bpe-chunks")
    n = chunks.count()
    if n == 0:
        return short
    tasks = min(4096, max(1, n // 8))
    bounds = chunks.repartition(tasks, "uid", "part").mapInArrow(_seam_rows(tokenizer, overlap), _SEAM_ROWS)
    pieces = stored(bounds.groupBy("uid").applyInPandas(_stitch, "uid long, part int, whole boolean, first long, end long"), "bpe-pieces")
    parts = chunks.join(pieces.where("NOT whole").drop("whole"), ["uid", "part"]).repartition(tasks, "uid", "part")
    encoded = parts.select("uid", "doc_id", "part", "content", "first", "end").mapInArrow(_encode_pieces(tokenizer), "uid long, doc_id long, part int, ids binary")
    stitched = encoded.groupBy("uid").applyInPandas(_join_pieces, "doc_id long, ids binary")
    rest = chunks.join(pieces.where("whole").select("uid").distinct(), "uid", "left_semi")
    whole = rest.groupBy("uid").applyInPandas(_encode_whole(tokenizer), "doc_id long, ids binary")
    return short.unionByName(stitched).unionByName(whole)


def decode(encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``doc_id, decoded binary`` of rows ``doc_id, ids``: the raw bytes of the ids, one after another."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches):
        for batch in in_steps(batches, "ids"):
            raw = [tokenizer.decode(np.frombuffer(x or b"", np.int32).tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of rows ``doc_id, ids``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        for batch in in_steps(batches, "ids"):
            each = [np.frombuffer(x or b"", np.int32).tolist() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) for x in each], "ids_sha256": [sha(tokenizer.digits(x)) for x in each], "decoded_sha256": [sha(tokenizer.decode(x)) for x in each]}, schema
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
