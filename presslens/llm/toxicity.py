"""Toxicity scores from a counterfactually regularised linear classifier.

Features of a document: its distinct words (lower case, outer punctuation off) and their
first four, five and six letters, present or not. The features used are those whose odds
among toxic and other documents differ most clearly, by 2.5 standard errors at least. The
weights minimise

    mean logistic loss + l2 |w|^2 + counterfactual * mean (score(s) - score(s'))^2

where s is a sentence of a labelled document that names a group of people and s' the same
sentence with the name swapped for the next one of its set. The last term takes weight off
such names, so a neutral mention does not make a document look toxic. Identity terms are
always among the features if the training rows hold them; the sets are a parameter, and a
model tells how many swaps it was fitted with. Rows without any of the terms have no swaps,
and the fit is then a logistic regression.

The fit uses at most ``max_labels`` labelled rows (those with the smallest hash of the id):
that bounds the broadcast of labels, the stored features and each gradient. The features
are counted and the gradients summed by Spark tasks; the driver holds one weight vector.
Scoring reads every whole text once, without a shuffle.

Null and empty texts have no features and get the score of the intercept. A label counts
as toxic if any row of its document says so; null labels and labels of other documents
are left out. Without any label, or with labels of one kind only, the score is the mean label
(0 without labels).
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from presslens.llm.common import free_names, row_slices, stored, text_or_empty

MAX_LABELS = 60_000
MAX_FEATURES = 8192
#: Names of groups in English, French, German and Spanish, in sets whose members can stand for one another.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"), ("muslim", "christian", "jewish", "hindu", "buddhist"), ("muslims", "christians", "jews", "hindus"),
    ("immigrants", "natives"), ("old", "young"), ("disabled", "deaf", "blind"), ("african", "american", "european", "mexican", "arab", "chinese"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("homosexuel", "hétérosexuel"), ("lesbienne", "hétérosexuelle"),
    ("noirs", "blancs", "asiatiques"), ("musulman", "chrétien", "juif", "hindou"), ("musulmans", "chrétiens", "juifs", "hindous"),
    ("immigrés", "autochtones"), ("handicapé", "sourd", "aveugle"), ("africain", "américain", "européen", "mexicain", "arabe", "chinois"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("schwul", "heterosexuell"), ("schwarze", "weiße", "asiaten"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch"), ("muslime", "christen", "juden", "hindus"), ("einwanderer", "einheimische"),
    ("behindert", "gehörlos"), ("afrikaner", "amerikaner", "europäer", "mexikaner", "araber", "chinesen"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("chicas", "chicos"), ("homosexual", "heterosexual"), ("negros", "blancos", "asiáticos"),
    ("musulmán", "cristiano", "judío", "hindú"), ("musulmanes", "cristianos", "judíos", "hindúes"), ("inmigrantes", "nativos"),
    ("discapacitado", "sordo", "ciego"), ("africanos", "americanos", "europeos", "mexicanos", "árabes", "chinos"),
)
_OUTER = string.punctuation + "«»“”„‘’…–—¿¡"
_SENTENCE = re.compile(r"[.!?\n]+")
_REMEMBERED = 500_000


def swaps_of(terms: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    """term -> the next one of its set; of a term in several sets, the first counts."""
    out: dict[str, str] = {}
    for own in terms:
        for i, term in enumerate(own):
            out.setdefault(term.lower(), own[(i + 1) % len(own)].lower())
    return out


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """True for the rows whose labels must not be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _features_of(word: str) -> tuple[str, ...]:
    core = word.strip(_OUTER)
    return (core, *[core[:n] + "*" for n in (4, 5, 6) if len(core) > n]) if core else ()


class _Chosen(dict):
    """word -> numbers of its chosen features, worked out at first sight."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.numbers[f] for f in _features_of(word) if f in self.numbers)
        if len(self) < _REMEMBERED:
            self[word] = found
        return found

    def of(self, text: str) -> list[int]:
        return sorted(set().union(*map(self.__getitem__, set(text.lower().split()))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature by label, summed over the task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in row_slices(batches, text=0):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update({f for word in set(text.lower().split()) for f in _features_of(word)})
    names = list(counts[0].keys() | counts[1].keys())
    for a in range(0, len(names), 100_000):
        part = names[a:a + 100_000]
        yield pa.RecordBatch.from_pydict({"feature": part, "clean": [counts[0][f] for f in part], "toxic": [counts[1][f] for f in part]})


def _sparse(names: list[str], swap: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = _Chosen({f: i for i, f in enumerate(names)})
        for batch in row_slices(batches, text=0):
            out = {"toxic": [], "has": [], "gains": [], "loses": []}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(toxic, chosen.of(text), [], [])]
                if not swap.keys().isdisjoint(w.strip(_OUTER) for w in set(text.lower().split())):
                    for sentence in _SENTENCE.split(text.lower()):
                        swapped = " ".join(swap.get(w.strip(_OUTER), w) for w in sentence.split())
                        a, b = set(chosen.of(sentence)), set(chosen.of(swapped))
                        if a != b:
                            rows.append((None, [], sorted(b - a), sorted(a - b)))
                for row in rows:
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            kinds = {"toxic": pa.int32(), **{c: pa.list_(pa.int32()) for c in ("has", "gains", "loses")}}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in out.items()})
    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row number, feature) of the entries of a list column."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False)


def _gradient(weights: np.ndarray):
    """Sums over a task: [loss, labelled rows, swap loss, swaps], gradient of each loss."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(weights) - 1  # the last weight is the intercept
        head, fit, swap = np.zeros(4), np.zeros(size + 1), np.zeros(size + 1)
        for batch in batches:
            toxic = batch.column(0)
            labelled = toxic.is_valid().to_numpy(zero_copy_only=False)
            y = toxic.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
            rows, found = _flat(batch.column(1))
            z = np.bincount(rows, weights[found], len(y)) + weights[size]
            error = np.where(labelled, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y, 0.0)
            head[0] += (np.logaddexp(0, z) - y * z)[labelled].sum()
            head[1] += labelled.sum()
            fit[:size] += np.bincount(found, error[rows], size)
            fit[size] += error.sum()
            change = np.zeros(len(y))
            parts = [(*_flat(batch.column(c)), sign) for c, sign in ((2, 1.0), (3, -1.0))]
            for at, f, sign in parts:
                change += sign * np.bincount(at, weights[f], len(y))
            for at, f, sign in parts:
                swap[:size] += sign * np.bincount(f, 2 * change[at], size)
            head[2] += (change ** 2).sum()
            head[3] += (~labelled).sum()
        yield pa.RecordBatch.from_pydict({"sums": pa.array([np.concatenate([head, fit, swap])], pa.list_(pa.float64()))})
    return run


def _minimise(loss, start: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with a halving step; ``loss`` gives (value, gradient)."""
    w, (value, grad) = start, loss(start)
    pairs: list = []
    for _ in range(steps):
        direction, used = -grad, []
        for s, y in reversed(pairs):
            a = (s @ direction) / (s @ y)
            used.append(a)
            direction = direction - a * y
        if pairs:
            s, y = pairs[-1]
            direction = direction * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            direction = direction + (a - (y @ direction) / (s @ y)) * s
        slope, size = grad @ direction, 1.0 if pairs else 1.0 / max(1.0, float(np.abs(grad).sum()))
        for _ in range(8):
            new = w + size * direction
            new_value, new_grad = loss(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        if (new - w) @ (new_grad - grad) > 1e-12:
            pairs = [*pairs, (new - w, new_grad - grad)][-memory:]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return w


class ToxicityModel:
    """``swaps``: sentences of the training rows in which swapping a name changes the features."""

    def __init__(self, names: list[str], weights: np.ndarray, swaps: int = 0):
        self.names, self.weights, self.swaps = names, weights, swaps

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """``docs`` without its text, with the score of every text (in place of a column of that name)."""
        return self._scored(docs, text_col, out, [c for c in docs.columns if c.lower() not in (text_col.lower(), out.lower())])

    def _scored(self, docs: DataFrame, text_col: str, out: str, others: list[str]) -> DataFrame:
        names, weights = self.names, self.weights
        schema = docs.select(*others).schema.add(out, "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chosen, bias = _Chosen({f: i for i, f in enumerate(names)}), float(weights[-1])
            for batch in row_slices(batches, text=0):
                z = [bias + sum(weights[f] for f in chosen.of(text)) for text in batch.column(0).to_pylist()]
                score = [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in z]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64())], [*others, out])

        return docs.select(text_or_empty(text_col).alias(text_col), *others).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labels: int = MAX_LABELS,
        max_features: int = MAX_FEATURES, least_documents: int = 3, least_clear: float = 2.5, l2: float = 1e-4, counterfactual: float = 1.0, steps: int = 30,
        identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> ToxicityModel:
    """Learn from the labelled documents, without those held out."""
    swap = swaps_of(identity_terms)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    known = stored(known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labels), "labels")
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("x"))
    rows = own.join(F.broadcast(known), F.col("id") == F.col("label_id")).select("x", "y")  # at most max_labels rows of 12 bytes
    texts = stored(rows, "labelled")
    kinds = {r[0]: r[1] for r in texts.groupBy("y").count().collect()}
    if len(kinds) < 2:
        only = next(iter(kinds), 0)
        return ToxicityModel([], np.array([500.0 if only else -500.0]))
    counts = texts.mapInArrow(_count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    odds = F.log((F.col("t") + 0.5) / (kinds[1] - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (kinds[0] - F.col("c") + 0.5))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    identity = F.col("feature").isin(*swap).cast("int")
    clear = (F.col("c") + F.col("t") >= least_documents) & ((identity == 1) | (F.abs(odds) / error >= least_clear))
    best = counts.filter(clear).orderBy(identity.desc(), (F.abs(odds) / error).desc(), "feature").limit(max_features)
    names = [r[0] for r in best.select("feature").collect()]
    features = stored(texts.mapInArrow(_sparse(names, swap), "toxic int, has array<int>, gains array<int>, loses array<int>"), "features")
    size = len(names) + 1

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        sums = np.sum([r[0] for r in features.mapInArrow(_gradient(w), "sums array<double>").collect()], axis=0)
        n, swaps = max(1.0, sums[1]), max(1.0, sums[3])
        value = sums[0] / n + l2 * (w[:-1] @ w[:-1]) + counterfactual * sums[2] / swaps
        return value, sums[4:4 + size] / n + 2 * l2 * np.append(w[:-1], 0.0) + counterfactual * sums[4 + size:] / swaps

    start = np.zeros(size)
    start[-1] = math.log(kinds[1] / kinds[0])
    return ToxicityModel(names, _minimise(loss, start, steps), features.filter("toxic is null").count())


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns."""
    model = fit(docs, labels, id_col, text_col, **options)
    copy, score = free_names(docs, "x_text", "x_score")
    return model._scored(docs.withColumn(copy, F.col(text_col)), copy, score, docs.columns).filter(F.col(score) < threshold).select(*docs.columns)
