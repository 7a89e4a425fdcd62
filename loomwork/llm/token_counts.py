"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are additive: a document that
comes in adds its counts, one that goes takes them away, and a revised one takes
its old counts away and adds the new ones. Changes arrive in batches. A batch is
reduced to one signed row for each group it touches and committed under its
name; totals are the sum over all committed batches, and ``compact`` folds them
into a snapshot.

Commits are idempotent and atomic. The rows of a batch are written to a folder of
their own; then a marker of the batch's name, which says which folder counts, is put
in place in one step that fails if there is a marker. So of two writers of one
name one gets True and the other False, a job may be repeated after any failure,
and a reader sees a batch whole or not at all. What a writer without success has
written is never read.

``compact`` lists the batches once, sums exactly these, and puts a marker with the
sum's folder and the names of all batches in it, again in one step. Batches
committed meanwhile are not in it and keep counting. Names that were folded in
stay known, so committing them again still does nothing. Files go one compaction
after they were folded in: a reader that began before a compaction still finds
what it has listed.

Defined cases: a null text has no tokens but counts as a document. Null sources
and languages are groups of their own. A change with neither an old nor a new
document does nothing. Groups whose totals are all zero are left out. Rows with
equal ids, and repeated rows, count each. A very long text is one step of the
task that reads it. Ties cannot arise. Other columns are ignored. Without a batch,
or with an empty one, the totals are empty.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.bpe import Tokenizer
from loomwork.llm.shared import bounded_batches, in_steps, text_buffers, word_spans

GROUP = ("source", "lang", "tokenizer")
MEASURES = ("n_docs", "n_tokens", "n_bytes")
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"


def count_tokens(docs: DataFrame, version: str, tokenizer: Tokenizer | None, text_column: str = "text") -> DataFrame:
    """``source, lang, tokenizer, n_tokens, n_bytes`` for every row; without a tokenizer, words are counted."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_column).alias("text"))

    def run(batches):
        for batch in in_steps(batches, "text"):
            data, offsets = text_buffers(batch.column("text"))
            if tokenizer is None:
                n = np.diff(word_spans(data, offsets)[2])
            else:
                n = np.array([len(tokenizer.encode(t)) if t else 0 for t in batch.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("source"), batch.column("lang"), pa.array([version] * batch.num_rows), pa.array(n), pa.array(np.diff(offsets))], ["source", "lang", "tokenizer", "n_tokens", "n_bytes"]
            )

    return rows.mapInArrow(run, "source string, lang string, tokenizer string, n_tokens long, n_bytes long")


def inserts(counts: DataFrame) -> DataFrame:
    """Signed changes that add counted documents."""
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed changes that take counted documents away."""
    return counts.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed changes of documents that were counted as ``old`` and now count as ``new``."""
    return deletes(old).unionByName(inserts(new))


class Rollups:
    """Committed batches of signed counts in a folder of any file system that Spark reads.

    Under it are ``rows/<folder>`` with the rows of a batch or a snapshot,
    ``batches/<name>`` with the folder of a batch, and ``snapshots/<number>`` with
    the folder of a snapshot and what is folded into it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        at = self._path(f"{self.folder}/{kind}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _text(self, place: str) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/{place}"))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, place: str, text: str) -> bool:
        """Put a file with its whole content in one step; False if the place is taken."""
        aside, target = (self._path(f"{self.folder}/{x}") for x in (f"aside/{uuid.uuid4().hex}", place))
        for path in (aside, target):
            self._fs.mkdirs(path.getParent())
        stream = self._fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() != "file":
                return not self._fs.exists(target) and self._fs.rename(aside, target)  # a rename fails where a file is
            # A local rename replaces files; a link fails if its name is taken.
            local = lambda path: self._jvm.java.io.File(path.toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(local(target), local(aside))
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(aside, False)

    def _snapshot(self) -> tuple[str | None, str | None, list[str]]:
        """Name, folder and batches of the newest snapshot."""
        names = self._names("snapshots")
        if not names:
            return None, None, []
        held = json.loads(self._text(f"snapshots/{names[-1]}"))
        return names[-1], held["folder"], held["batches"]

    def _state(self) -> tuple[str | None, str | None, list[str], dict[str, str]]:
        """The newest snapshot, and the folders of the batches that it has not folded in."""
        while True:
            name, folder, folded = self._snapshot()
            known = set(folded)
            names = [b for b in self._names("batches") if b not in known]
            # A compaction meanwhile may have removed markers: look again.
            if self._snapshot()[0] == name:
                return name, folder, folded, {b: self._text(f"batches/{b}") for b in names}

    def committed(self) -> set[str]:
        """Names of all batches that count, folded into a snapshot or not."""
        _, _, folded, names = self._state()
        return {*folded, *names}

    def _write(self, df: DataFrame) -> str:
        folder = uuid.uuid4().hex
        df.write.mode("error").parquet(f"{self.folder}/rows/{folder}")
        return folder

    def _remove(self, *places: str) -> None:
        for place in places:
            self._fs.delete(self._path(f"{self.folder}/{place}"), True)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit signed changes under a name; False, and no effect, if that name was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.committed():
            return False
        signed = [F.sum(F.col("sign") * (F.lit(1) if m == "n_docs" else F.col(m))).cast("long").alias(m) for m in MEASURES]
        folder = self._write(changes.groupBy(*GROUP).agg(*signed))
        # A name that was folded in while the rows were written has lost its marker, but is known.
        if batch not in self._snapshot()[2] and self._put(f"batches/{batch}", folder):
            return True
        self._remove(f"rows/{folder}")
        return False

    def _sum(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _DELTA)
        rows = self.spark.read.schema(_DELTA).parquet(*[f"{self.folder}/rows/{f}" for f in folders])
        found = rows.groupBy(*GROUP).agg(*[F.sum(m).alias(m) for m in MEASURES])
        return found.where(" OR ".join(f"{m} <> 0" for m in MEASURES))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens, n_bytes``: the sum of all committed batches."""
        _, folder, _, names = self._state()
        return self._sum([*names.values(), *([folder] if folder else [])])

    def compact(self) -> bool:
        """Fold the batches committed so far into a new snapshot; False if another compaction came first."""
        name, folder, folded, names = self._state()
        new = self._write(self._sum([*names.values(), *([folder] if folder else [])]))
        number = int(name) + 1 if name else 0
        if not self._put(f"snapshots/{number:012d}", json.dumps({"folder": new, "batches": sorted([*folded, *names]), "before": folder, "rows": sorted(names.values())})):
            self._remove(f"rows/{new}")
            return False
        if name:  # what the snapshot before had folded in: no reader of today's state needs it
            held = json.loads(self._text(f"snapshots/{name}"))
            self._remove(*[f"batches/{b}" for b in folded], *[f"rows/{f}" for f in [*held["rows"], held["before"]] if f])
        return True
