"""Toxicity: a logistic classifier that is penalised when swapping identity terms changes a score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ALPHANUMERIC, annotate, raw_texts, slices, words_of

#: Labelled rows that the classifier is fitted on, at most: those of the smallest hash of their id.
SAMPLE_ROWS = 20_000
FEATURES = 2048
THRESHOLD = 0.7
PREFIX = 5
_PREFIXES = np.uint64(0x9E3779B97F4A7C15)

#: Terms that name groups, by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = (
    ("woman", "man", "women", "men", "girl", "boy", "trans", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("christian", "muslim", "jewish", "jew", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrant", "refugee", "foreigner", "native", "disabled", "blind", "deaf", "old", "young"),
    ("frau", "mann", "frauen", "männer", "schwul", "lesbisch", "christ", "muslimisch", "jüdisch", "ausländer"),
    ("femme", "homme", "femmes", "hommes", "musulman", "juif", "chrétien", "noir", "blanc", "étranger"),
    ("mujer", "hombre", "mujeres", "hombres", "musulmán", "judío", "cristiano", "negro", "blanco", "extranjero"),
)


def term_hash(term: str) -> int:
    data, offsets = raw_texts(pa.array([term]))
    return int(words_of(data, offsets, ALPHANUMERIC)[0][0])


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice: first and last row, and (row, hash) of the words and word beginnings of each text, repeats included."""
    data, offsets = raw_texts(column)
    for begin, end in slices(offsets):
        part, borders = data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        hashes, first, last, counts = words_of(part, borders, ALPHANUMERIC)
        row = np.repeat(np.arange(end - begin), np.diff(counts))
        long = last - first > PREFIX
        if long.any():
            starts = first[long]
            heads = part[starts[:, None] + np.arange(PREFIX)].ravel()
            prefix = words_of(heads, np.arange(0, len(heads) + 1, PREFIX), np.ones(256, bool))[0] ^ _PREFIXES
            hashes, row = np.concatenate([hashes, prefix]), np.concatenate([row, row[long]])
        yield begin, end, row, hashes


def _known(known: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, number of the feature) of the features that ``known`` (sorted) holds."""
    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
    hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
    pairs = np.unique(row[hit] * max(1, len(known)) + at[hit])
    return pairs // max(1, len(known)), pairs % max(1, len(known))


@dataclass
class Model:
    known: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for begin, end, row, hashes in _features(column):
            r, f = _known(self.known, row, hashes)
            out[begin:end] += np.bincount(r, self.weights[f], minlength=end - begin)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _fit(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, swaps: list[tuple[int, int, int]], width: int, *, swap_weight: float, l1: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Proximal gradient steps (Adam) on: log loss + swap_weight * mean squared change of the logit under swaps + l1, l2.

    ``swaps``: (row, feature that goes, feature that comes) of the counterfactual sentences.
    """
    n = max(1, len(labels))
    w, b = np.zeros(width), float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))) if len(labels) else -40.0
    if not len(labels):
        return w, b
    # The rarer class counts more, by the root of the ratio.
    weight = np.where(labels > 0, max(1.0, (n - labels.sum()) / max(1.0, labels.sum())) ** 0.5, 1.0)
    out = np.array([s[1] for s in swaps], np.int64)
    come = np.array([s[2] for s in swaps], np.int64)
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[columns], minlength=len(labels)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / n
        g = np.bincount(columns, error[rows], minlength=width) + l2 * w
        if len(swaps):
            change = 2 * swap_weight * (w[out] - w[come]) / len(swaps)
            g += np.bincount(out, change, minlength=width) - np.bincount(come, change, minlength=width)
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * (1 - 0.9 * step / steps)
        scale = np.sqrt(v / (1 - 0.999**step)) + 1e-8
        w = w - rate * m / (1 - 0.9**step) / scale
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1 / scale)
        b -= rate * mb / (1 - 0.9**step) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w, b


def train(documents: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
          sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, identity_terms=IDENTITY_TERMS, swap_weight: float = 5.0,
          l1: float = 2e-5, l2: float = 1e-5, steps: int = 400) -> Model:
    """A model from at most ``sample_rows`` labelled rows; ``labels`` must already be without the rows held out.

    The sample's ids (a bounded number) go to the documents, which are read in place. Words and beginnings of words
    that tell the classes apart best are counted by Spark and ``features`` of them chosen; the sample's rows in these
    features are fitted on the driver. Identity terms are always among the features; each labelled text that holds one
    has counterfactual twins with the other terms of its kind, whose scores must stay.

    Ids and labels that are null teach nothing; a repeated label counts once, 1 before 0. Without labels every score is 0.
    """
    sample = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).dropna()
    sample = sample.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    picked = {r["id"]: r["label"] for r in sample.collect()}
    bounded = documents.sparkSession.createDataFrame(list(picked.items()) or [], "id bigint, label int")
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(bounded), "id").select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, end, row, hashes in _features(batch.column(1)):
                distinct, number = np.unique(hashes, return_inverse=True)
                pairs = np.unique(number * (end - begin) + row) if len(number) else number
                f, r = pairs // (end - begin), pairs % (end - begin)
                toxic = np.bincount(f, label[begin:end][r], minlength=len(distinct)).astype(np.int64)
                every = np.bincount(f, minlength=len(distinct)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(toxic), pa.array(every)], names=["feature", "toxic", "every"])

    totals = texts.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("every")).first()
    positive, negative = float(totals["toxic"] or 0), float(totals["every"] - (totals["toxic"] or 0))
    counts = texts.mapInArrow(count, "feature bigint, toxic bigint, every bigint").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("every").alias("n"))
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    gap = F.abs(F.log(a / (positive - F.col("a") + 0.5)) - F.log(b / (negative - (F.col("n") - F.col("a")) + 0.5)))
    best = counts.where(F.col("n") >= 2).orderBy((gap / F.sqrt(1 / a + 1 / b)).desc(), "feature").limit(features).collect()
    kinds = [[term_hash(t) for t in kind] for kind in identity_terms]
    chosen = np.array([r["feature"] for r in best], np.int64).view(np.uint64)
    known = np.unique(np.concatenate([chosen, np.array([h for kind in kinds for h in kind], np.uint64)]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, row, hashes in _features(batch.column(1)):
                r, f = _known(known, row, hashes)
                lists = np.split(f, np.searchsorted(r, np.arange(1, end - begin)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:end], pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))], names=["label", "features"])

    got = texts.mapInArrow(rows, "label int, features array<int>").collect()
    got.sort(key=lambda r: (r["label"], r["features"]))  # so that the sums do not depend on the order of arrival
    y = np.array([r["label"] for r in got], float)
    sizes = np.array([len(r["features"]) for r in got], np.int64)
    columns = np.array([f for r in got for f in r["features"]], np.int64)
    of = {int(h): [int(o) for o in kind if o != h] for kind in kinds for h in kind}
    number = {int(h): i for i, h in enumerate(known)}
    terms = {number[h]: [number[o] for o in others] for h, others in of.items()}
    swaps = [(i, f, o) for i, r in enumerate(got) for f in r["features"] if f in terms for o in terms[f] if o not in r["features"]]
    w, bias = _fit(np.repeat(np.arange(len(got)), sizes), columns, y, swaps, len(known), swap_weight=swap_weight, l1=l1, l2=l2, steps=steps)
    return Model(known, w, bias)


def score(documents: DataFrame, model: Model, *, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on), over whole texts, in place.

    Null and empty texts get the score of a text without any known word.
    """
    scored = annotate(documents, text_column, lambda column: [pa.array(model.scores(column))], "score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
