"""Quality classifier: regularised quadratic discriminant over document statistics.

Each document becomes a short vector of transformed statistics of its words and bytes. For either
class a mean and a shrinkage covariance come from moments summed over the labelled
documents; the score is the logistic of the difference of the two Gaussian log densities, taken
from Cholesky factors that are inverted once.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.llm.frames import crc_fold, kept
from outlay.llm.words import WordHasher, chunks

FEATURES = (
    "log_words",
    "word_length",
    "word_length_spread",
    "distinct_words",
    "repeated_next",
    "top_word",
    "symbols",
    "digits",
    "upper",
    "sentence_marks",
    "lines",
    "short_words",
)
SYMBOLS = b"#*$%&|<>"
SHRINKAGE = 0.1


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(sums[bounds])


def document_features(docs: DataFrame) -> DataFrame:
    """docs' columns other than text, and FEATURES of the whole text as doubles.

    Counts enter as smoothed logarithms of shares, which keeps one odd word of a long text from
    dominating. Null and empty texts have the values of no words.
    """
    names = [c for c in docs.columns if c != "text"]
    bytes_of = {
        "symbols": np.isin(np.arange(256), list(SYMBOLS)),
        "digits": np.isin(np.arange(256), list(b"0123456789")),
        "upper": np.isin(np.arange(256), list(range(65, 91))),
        "sentence_marks": np.isin(np.arange(256), list(b".,;:!?")),
        "lines": np.arange(256) == 10,
    }

    def features(batches):
        hasher = WordHasher()
        for batch in batches:
            blocks = []
            for chunk in chunks(batch.column(len(names))):
                words = hasher.words(chunk)
                n = np.diff(words.first).astype(np.float64)
                some = np.maximum(n, 1)
                owner, length = words.text_of(), words.end - words.start
                letters = np.add.reduceat(np.append(length, 0), words.first[:-1]) * (n > 0)
                squares = np.add.reduceat(np.append(length**2, 0), words.first[:-1]) * (n > 0)
                mean = letters / some
                spread = np.sqrt(np.maximum(squares / some - mean**2, 0))
                order = np.lexsort((words.hash, owner))
                same = np.zeros(len(order), dtype=bool)
                same[1:] = (np.diff(words.hash[order]) == 0) & (np.diff(owner[order]) == 0)
                starts = np.flatnonzero(~same)
                runs = np.diff(np.append(starts, len(order)))
                owners = owner[order][starts]
                distinct = np.bincount(owners, minlength=len(n))
                top = np.zeros(len(n))
                np.maximum.at(top, owners, runs)
                again = np.zeros(len(owner), dtype=np.int64)
                again[1:] = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
                share = {
                    k: np.log(
                        (_per_text(flag[chunk.data], chunk.bounds) + 0.5)
                        / (np.diff(chunk.bounds) + 20)
                    )
                    for k, flag in bytes_of.items()
                }
                block = {
                    **share,
                    "log_words": np.log1p(n),
                    "word_length": np.log1p(mean),
                    "word_length_spread": np.log1p(spread),
                    # types over a power of tokens depends little on a text's length
                    "distinct_words": np.log((distinct + 0.5) / (n + 0.5) ** 0.8),
                    "repeated_next": np.log(
                        (_per_text(again, words.first) + 0.5) / (some + 10)
                    ),
                    "top_word": np.log((top + 0.5) / (n + 3)),
                    "short_words": np.log(
                        (_per_text(length <= 3, words.first) + 0.5) / (n + 3)
                    ),
                }
                blocks.append(np.stack([block[k] for k in FEATURES], axis=1))
            table = np.concatenate(blocks) if blocks else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))]
                + [pa.array(table[:, i]) for i in range(len(FEATURES))],
                names=[*names, *FEATURES],
            )

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    fields += [f"{k} double" for k in FEATURES]
    return docs.select(*names, "text").mapInArrow(features, ", ".join(fields))


@dataclass
class Gaussian:
    """One class: share of the labelled rows, mean, inverse Cholesky factor, log determinant."""

    share: float
    mean: np.ndarray
    inverse_factor: np.ndarray
    log_det: float

    def log_density(self, columns: list[Column]) -> Column:
        """Log density plus log share, without the constant; Mahalanobis terms by the factor."""
        centred = [c - F.lit(float(m)) for c, m in zip(columns, self.mean)]
        terms = []
        for i in range(len(columns)):
            row = self.inverse_factor[i]
            z = centred[0] * F.lit(float(row[0]))
            for j in range(1, i + 1):
                z = z + centred[j] * F.lit(float(row[j]))
            terms.append(z * z)
        distance = terms[0]
        for t in terms[1:]:
            distance = distance + t
        return F.lit(float(np.log(self.share) - 0.5 * self.log_det)) - distance * F.lit(0.5)


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> dict[int, Gaussian]:
    """A Gaussian per class of `label` (0 or 1) from moments of FEATURES over all rows.

    The moments are one aggregation of (d + 1)(d + 2) / 2 sums per class. A class covariance is
    shrunk towards the diagonal of the pooled covariance. Classes without rows are missing.
    """
    d = len(FEATURES)
    cells = list(itertools.combinations_with_replacement(range(d), 2))
    sums = [F.count("*").alias("n")]
    sums += [F.sum(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"c{i}_{j}") for i, j in cells]
    rows = labelled.where("label in (0, 1)").groupBy("label").agg(*sums).collect()
    total, moments, pooled = sum(r["n"] for r in rows), {}, np.zeros((d, d))
    for r in rows:
        mean = np.array([r[f"m{i}"] for i in range(d)]) / r["n"]
        second = np.zeros((d, d))
        for i, j in cells:
            second[i, j] = second[j, i] = r[f"c{i}_{j}"] / r["n"]
        covariance = second - np.outer(mean, mean)
        moments[r["label"]] = r["n"], mean, covariance
        pooled += covariance * r["n"] / total
    target = np.diag(np.maximum(np.diag(pooled), 1e-3))
    found = {}
    for label, (n, mean, covariance) in moments.items():
        # few rows lean more on the common diagonal
        weight = max(shrinkage, d / (d + n))
        factor = np.linalg.cholesky((1 - weight) * covariance + weight * target)
        log_det = 2 * float(np.log(np.diag(factor)).sum())
        found[int(label)] = Gaussian(n / total, mean, np.linalg.inv(factor), log_det)
    return found


def score(model: dict[int, Gaussian]) -> Column:
    """Probability of class 1. With rows of one class only it is that class for sure, and 1 if
    nothing is labelled, so that a filter without evidence keeps everything."""
    if 0 not in model:
        return F.lit(1.0)
    if 1 not in model:
        return F.lit(0.0)
    columns = [F.col(k) for k in FEATURES]
    margin = model[1].log_density(columns) - model[0].log_density(columns)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(margin, F.lit(-500.0)), F.lit(500.0))))


def scored(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held_out: int = 2
) -> DataFrame:
    """docs' columns but text, with FEATURES, held_out, score and predicted.

    The model learns from labelled documents whose crc32(doc_id) modulo `folds` is not
    `held_out`. Only the text enters the score. Documents without id are held out; labels that
    are null or neither 0 nor 1 are ignored; an id labelled both ways counts for both; repeated
    labels count once. Other columns may have any name but those added.
    """
    clash = {"held_out", "score", "predicted", *FEATURES} - {"text"}
    features = kept(document_features(docs.drop(*clash)), "features")
    fold = F.coalesce(crc_fold(F.col("doc_id"), folds), F.lit(held_out))
    known = (
        labels.where("quality in (0, 1)").select("doc_id", F.col("quality").alias("label")).distinct()
    )
    seen = features.select("doc_id", *FEATURES).where(fold != held_out)
    model = fit(seen.join(known, "doc_id"))
    return (
        features.withColumn("held_out", fold == held_out)
        .withColumn("score", score(model))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
