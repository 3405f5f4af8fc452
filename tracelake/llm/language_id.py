"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are folded to lower-case letters and single blanks; their character 1-, 2- and
3-grams are hashed to DIMS features. Document frequencies count every labelled training
document. The classifier is fitted by follow-the-regularised-leader (proximal, per
coordinate rates, L1 and L2 penalties) on a bounded sample of SAMPLE_PER_LANGUAGE
labelled documents a language, in expectation, drawn by a hash; a fifth of the sample is
set aside to calibrate a temperature. Prediction runs over every whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is
every text when nothing can be learned; rows that repeat are predicted one by one; an
empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.llm.common import map_slices, quoted, stable_unit

DIMS = 1 << 14
SAMPLE_PER_LANGUAGE = 800
UNKNOWN = "und"
EPOCHS, ALPHA, BETA, L1, L2 = 3, 1.0, 1.0, 1e-4, 1e-4
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
    return _letters


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of one text; no features if it has no letter."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return none
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[codes]
    if not letter.any():
        return none
    codes = np.where(letter, codes, np.uint32(32))
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
    blank = codes == 32
    codes = codes[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    parts, acc = [], np.zeros(len(codes), np.uint32)
    for n, m in enumerate(_MULTIPLIERS):
        acc = acc[: len(codes) - n] * np.uint32(31) + codes[n:] * m
        mixed = (acc ^ (acc >> np.uint32(15))) * np.uint32(2246822507)
        parts.append(mixed >> np.uint32(18))
    counts = np.bincount(np.concatenate(parts), minlength=DIMS)
    features = np.flatnonzero(counts)
    return features, counts[features]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMS + 1 rows, the last is the bias
    temperature: float = 1.0

    def vector(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """TF-IDF values of unit length, and the bias feature."""
        values = (1 + np.log(counts)) * self.idf[features]
        norm = np.sqrt(values @ values)
        return np.append(features, DIMS), np.append(values / norm if norm else values, 0.1)

    def probabilities(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        index, values = self.vector(features, counts)
        return softmax(values @ self.weights[index] / self.temperature)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """Fit the weights on (class, features, counts) rows, in EPOCHS fixed orders."""
    k = len(model.languages)
    z, n = np.zeros((DIMS + 1, k)), np.zeros((DIMS + 1, k))

    def weights(at) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    vectors = [(c, *model.vector(f, v)) for c, f, v in rows]
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(vectors)):
            c, index, values = vectors[i]
            w = weights(index)
            error = softmax(values @ w)
            error[c] -= 1
            g = np.outer(values, error)
            root = np.sqrt(n[index] + g * g)
            z[index] += g - (root - np.sqrt(n[index])) / ALPHA * w
            n[index] += g * g
    model.weights = weights(slice(None))


def calibrate(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """The temperature of least negative log-likelihood on ``rows``, by golden-section search over its logarithm."""
    if not rows:
        return
    scores = np.array([(v := model.vector(f, n))[1] @ model.weights[v[0]] for _, f, n in rows])
    truth = np.array([c for c, _, _ in rows])

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))[np.arange(len(truth)), truth]
        return -np.log(np.maximum(p, 1e-300)).mean()

    a, b, ratio = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    model.temperature = float(np.exp((a + b) / 2))


def _document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Document frequency of each feature over all of ``docs``; each task sends one vector of DIMS counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[gram_counts(text)[0]] += 1
                seen[DIMS] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["feature", "n"])

    sums = map_slices(docs.select(text_col), run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(DIMS + 1, np.int64)
    for r in sums.collect():  # DIMS + 1 rows at most
        out[r.feature] = r.n
    return out[:DIMS], int(out[DIMS])


def train(
    docs: DataFrame, learnable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
) -> Model | None:
    """Learn from the rows of ``docs`` where ``learnable`` holds and the language is known; None if none of them has a letter."""
    known = docs.filter(learnable & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), stable_unit(F.col(id_col), F.col(text_col)).alias("u"), stable_unit(F.lit(1), F.col(id_col), F.col(text_col)).alias("part")
    )
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    df, total = _document_frequencies(known, "text")
    shares = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample_per_language / sizes[k])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [gram_counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([f.astype("<u2").tobytes() for f, _ in grams], pa.binary()),
                 pa.array([c.astype("<u4").tobytes() for _, c in grams], pa.binary())],
                names=["lang", "part", "features", "counts"],
            )

    sample = map_slices(
        known.filter(F.col("u") < shares[F.col("lang")]).select("lang", "text", "part"), run, "lang string, part double, features binary, counts binary"
    )
    rows = [
        (languages.index(r.lang), np.frombuffer(r.features, "<u2").astype(np.int64), np.frombuffer(r.counts, "<u4").astype(np.int64), r.part)
        for r in sample.toLocalIterator()
    ]
    rows = sorted((r for r in rows if len(r[1])), key=lambda r: (r[3], r[0], r[1].tobytes()))
    if not rows:
        return None
    model = Model(languages, np.log((1 + total) / (1 + df)) + 1, np.zeros((DIMS + 1, len(languages))))
    fit_ftrl(model, [r[:3] for r in rows if r[3] >= 0.2] or [r[:3] for r in rows])
    calibrate(model, [r[:3] for r in rows if r[3] < 0.2])
    return model


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (replacing columns of these names); other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    # numbered names while in Python, so that columns may have any names
    numbered = [f"c{i}" for i in range(len(names))]
    rows = docs.select([F.col(quoted(c)).alias(n) for c, n in zip(names, numbered, strict=True)])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(at).to_pylist():
                features, counts = gram_counts(text) if own else ((), ())
                if not len(features):
                    langs.append(UNKNOWN), scores.append(0.0)
                    continue
                p = own.probabilities(features, counts)
                best = int(p.argmax())
                langs.append(own.languages[best]), scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*numbered, "lang_pred", "score"])

    schema = StructType(list(rows.schema))
    return map_slices(rows, run, schema.add("lang_pred", "string").add("score", "double")).toDF(*names, "lang_pred", "score")
