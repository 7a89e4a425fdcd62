"""Language ID by hierarchical discrimination.

A text's language family is predicted first; inside the family one-versus-one
linear support vector machines separate its languages. Both levels use the same
features: counts of the byte trigrams of the lower-cased whole text (runs of
bytes that are no letters are one space), hashed to ``DIM`` places, square
rooted and scaled to length 1.

Machines are trained on the driver from a sample of labelled rows that is
bounded by ``PER_LANGUAGE`` documents a language, the first of as many strata of a
hash of id and text, so reruns agree and no language with a labelled row is left
out; its features are computed on the executors. The weights are a
few vectors of ``DIM`` numbers for each pair of families or of languages of a
family, and travel with the tasks.

Defined cases: a null text, or one without a letter, is ``und`` with score 0.
Without any labelled row every text is ``und``; with one language every text
with a letter is of it, with score 1. Equal votes go to the larger sum of
margins, then to the earlier name. A null id is not held out and not learned
from. Rows with equal ids are told apart by their texts when the sample is drawn;
repeated rows count once there, and each gets its prediction. Very long texts are
read whole, a step of the task each. Other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import bounded_batches, in_steps, text_buffers

#: Places of the hashed trigrams, labelled documents a language at most, rows of a step.
DIM, PER_LANGUAGE, ROWS = 4096, 300, 256
#: Weight of errors against the size of the weights.
PENALTY = 10.0
UNDETERMINED = "und"

#: ISO 639-1 codes of closely related languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "turkic": "az kk ky tk tr tt uz",
    "uralic": "et fi hu se",
    "baltic": "lt lv",
    "malayo-polynesian": "id jv mg ms su tl",
    "dravidian": "kn ml ta te",
    "celtic": "br cy ga gd",
    "tai": "lo th",
}
_FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages.split()}


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language, f"of {language}")


_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def features(column: pa.Array) -> np.ndarray:
    """A row of ``DIM`` features for each text."""
    data, offsets = text_buffers(pc.utf8_lower(column))
    n = len(offsets) - 1
    counts = np.zeros(n * DIM, np.float64)
    if len(data) >= 3:
        plain = _LETTERS[data].astype(np.uint32)
        row = np.repeat(np.arange(n), np.diff(offsets))
        code = (plain[:-2] << 16) | (plain[1:-1] << 8) | plain[2:]
        inside = (row[:-2] == row[2:]) & ~((plain[:-2] == 32) & (plain[1:-1] == 32)) & ~((plain[1:-1] == 32) & (plain[2:] == 32))
        place = (code * np.uint32(2654435769)) >> np.uint32(32 - DIM.bit_length() + 1)
        counts = np.bincount(row[:-2][inside] * DIM + place[inside], minlength=n * DIM).astype(np.float64)
    x = np.sqrt(counts.reshape(n, DIM))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 25) -> np.ndarray:
    """Weights and, last, the bias of a linear SVM with squared hinge loss; y is 1 or -1, classes weigh alike.

    Newton's method on the primal; each step solves for the rows inside the
    margin by conjugate gradients.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y = y.astype(x.dtype)
    c = np.where(y > 0, penalty * len(y) / (2 * max(1, (y > 0).sum())), penalty * len(y) / (2 * max(1, (y < 0).sum()))).astype(x.dtype)
    w = np.zeros(x.shape[1], x.dtype)
    loss = lambda v: 0.5 * v @ v + (c * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    now = loss(w)
    for _ in range(steps):
        short = 1 - y * (x @ w)
        on = short > 0
        xo, co = x[on], c[on]
        gradient = w - 2 * xo.T @ (co * (y * short)[on])
        if gradient @ gradient < 1e-10 * max(1.0, w @ w):
            break
        d, r = np.zeros_like(w), -gradient
        p, rr = r.copy(), r @ r
        first = rr
        for _ in range(100):
            hp = p + 2 * xo.T @ (co * (xo @ p))
            alpha = rr / (p @ hp)
            d += alpha * p
            r -= alpha * hp
            rr, old = r @ r, rr
            if rr < 1e-6 * first:
                break
            p = r + rr / old * p
        t = 1.0
        while loss(w + t * d) > now and t > 1e-6:
            t /= 2
        w = w + t * d
        now = loss(w)
    return w


@dataclass
class Model:
    """Machines for pairs of families and for pairs of languages of a family."""

    languages: list[str] = field(default_factory=list)
    machines: dict[tuple[str, str, str], np.ndarray] = field(default_factory=dict)

    def _vote(self, level: str, names: list[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the place of the winner and how sure its closest pair was, 0 to 1."""
        if len(names) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        votes, margins = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        least = np.full((len(x), len(names)), np.inf)
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            w = self.machines[level, a, b]
            m = x @ w[:-1] + w[-1]
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            margins[:, i] += m
            margins[:, j] -= m
            np.minimum(least[:, i], m, out=least[:, i])
            np.minimum(least[:, j], -m, out=least[:, j])
        order = votes + (np.tanh(margins / len(names)) + 1) / 4  # less than half a vote
        best = order.argmax(1)
        sure = 1 / (1 + np.exp(-np.clip(4 * least[np.arange(len(x)), best], -50, 50)))
        return best, sure

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        families = sorted({family_of(a) for a in self.languages})
        at, sure = self._vote("family", families, x)
        names = np.empty(len(x), object)
        for i, family in enumerate(families):
            rows = np.flatnonzero(at == i)
            if len(rows):
                own = sorted(a for a in self.languages if family_of(a) == family)
                which, s = self._vote(family, own, x[rows])
                names[rows] = [own[k] for k in which]
                sure[rows] *= s
        return names.tolist(), sure


def fit(x: np.ndarray, languages: list[str]) -> Model:
    """Train a model on features and their languages."""
    labels = np.array(languages, object)
    model = Model(sorted(set(languages)))
    families = np.array([family_of(a) for a in languages], object)

    def pairs(level: str, names: list[str], of: np.ndarray) -> None:
        for a, b in combinations(names, 2):
            rows = np.flatnonzero((of == a) | (of == b))
            model.machines[level, a, b] = train_svm(x[rows], np.where(of[rows] == a, 1.0, -1.0))

    pairs("family", sorted(set(families)), families)
    for family in sorted(set(families)):
        pairs(family, [a for a in model.languages if family_of(a) == family], labels)
    return model


def _featured(batches):
    schema = pa.schema([("lang", pa.string()), ("x", pa.binary())])
    for batch in in_steps(batches, "text"):
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            x = features(part.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([v.tobytes() for v in x], pa.binary())], schema=schema)


def sample(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """``lang, text`` of at most ``per_language`` labelled rows a language, and of one at least."""
    rows = labelled.where(F.col(lang_column).isNotNull()).select(F.col(lang_column).alias("lang"), F.coalesce(text_column, F.lit("")).alias("text"), F.col(id_column).alias("doc_id"))
    rows = rows.select("lang", "text", F.xxhash64(F.lit("langid"), "doc_id", "text").alias("h"))
    # The least hash of each stratum: per_language rows of a hash and a name for each language, so small enough to broadcast.
    least = rows.groupBy("lang", F.pmod("h", F.lit(per_language)).alias("stratum")).agg(F.min("h").alias("h")).select("lang", "h")
    return rows.join(F.broadcast(least), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def train(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from labelled rows, of which it takes a ``sample``."""
    bounded_batches(labelled.sparkSession)
    few = sample(labelled, id_column, text_column, lang_column, per_language)
    held = few.mapInArrow(_featured, "lang string, x binary").toArrow()  # per_language x languages x 16 kB
    if not held.num_rows:
        return Model()
    languages, rows = held.column("lang").to_pylist(), held.column("x").to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (languages[i], rows[i]))
    return fit(np.stack([np.frombuffer(rows[i], np.float32) for i in order]), [languages[i] for i in order])


def held_out(id_column: str | Column) -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2; false for a null id."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, text_column: str = "text", *kept: str) -> DataFrame:
    """The columns ``kept``, ``lang_pred`` and ``score`` for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*kept, F.col(text_column).alias("_text"))

    def run(batches):
        for batch in in_steps(batches, "_text"):
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                text = part.column("_text")
                letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if model.languages:
                    names, sure = model.predict(features(text))
                else:
                    names, sure = [UNDETERMINED] * len(letter), np.zeros(len(letter))
                names = [x if y else UNDETERMINED for x, y in zip(names, letter, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(names, pa.string()), pa.array(np.where(letter, sure, 0.0))], [*kept, "lang_pred", "score"])

    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + ["lang_pred string", "score double"])
    return rows.mapInArrow(run, schema)
