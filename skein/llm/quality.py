"""Quality classifier by co-training two views: a text's content, and the metadata of its page.

The content view is a linear model over the presence of words and over the text's shape; the metadata
view is a linear model over language, source and stated length. Each starts from the labelled sample. In
every round both views score all unlabelled documents, and each hands all that it is sure of, as
pseudo-labels, to the other view. What a view is handed is unbounded, so it isn't gathered: tasks count in
how many good and bad documents a feature stands, and only the counts, two for each of WIDTH features, reach
the driver. There they become log-odds weights, which are added to the ones fitted on the labelled rows, by
slopes calibrated on labelled rows that neither view was fitted on. After the rounds the calibrated views
are combined, and the result scores all documents.

The one sample is that of the labelled rows: at most LABELLED, those of least hash of doc_id. All else runs
over all documents. Features are extracted once and kept, two bytes each, in the checkpoint folder.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, cut, ship

WIDTH = 1 << 18  # hashed features of a view
LABELLED = 12_000
ROUNDS, SURE = 3, 0.95
SEEN, APART = 5, 6.0  # rows that a feature must be seen in, and standard errors between its shares in the two classes
SEED = 11
_WORDS = re.compile(r"[^\W\d_]+")


class Content:
    """Features of texts: words that occur and their beginnings, and buckets of shape statistics."""

    def __init__(self):
        self.slots = Recent(_slots, 100_000)

    def features(self, text: str | None) -> np.ndarray:
        text = text or ""
        words = _WORDS.findall(text.lower())
        counts = Counter(words)
        n, letters = max(1, len(words)), max(1, len(text))
        upper = sum(map(len, re.findall(r"[A-Z]+", text)))
        marks = len(text) - sum(map(len, re.findall(r"[\w\s.,]+", text)))
        tokens = text.split()
        twice = sum(a == b for a, b in zip(tokens, tokens[1:]))
        shape = (
            upper / letters, marks / letters, 1 - len(counts) / n, max(counts.values(), default=0) / n,
            twice / max(1, len(tokens)), sum(map(len, re.findall(r"\d+", text))) / letters,
        )
        buckets = [32 * i + min(31, int(32 * x**0.5)) for i, x in enumerate(shape)] + [32 * len(shape) + min(31, n.bit_length())]
        return np.fromiter(set(buckets).union(*map(self.slots.__getitem__, counts)), dtype=np.int32)


def _slots(word: str) -> tuple[int, ...]:
    """A word's feature and those of its beginnings, in which compounds are alike."""
    return tuple(1024 + xxhash.xxh3_64_intdigest(x) % (WIDTH - 1024) for x in {word, *(f"{word[:k]}-" for k in (4, 5, 6) if len(word) > k)})


def metadata_features(lang: object, source: object, n_chars: object) -> np.ndarray:
    size = int(n_chars).bit_length() if isinstance(n_chars, int) and n_chars > 0 else 0
    parts = (f"lang={lang}", f"source={source}", f"size={size}", f"pair={lang},{source}", "bias")
    return np.array([xxhash.xxh3_64_intdigest(p) % WIDTH for p in parts], dtype=np.int32)


@dataclass
class Linear:
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, features: np.ndarray) -> float:
        return self.slope * float(self.weights[features].sum()) + self.shift


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int) -> np.ndarray:
    """Which features, standing in so many good and bad rows, tell the classes apart: seen in SEEN rows, and APART standard errors."""
    share = (good + bad) / (n_good + n_bad)
    z = (good / n_good - bad / n_bad) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_good + 1 / n_bad))
    return (good + bad >= SEEN) & (np.abs(z) >= APART)


def fit(rows: list[np.ndarray], good: np.ndarray, steps: int = 200, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a ridge logistic model by Adam, with classes balanced; the intercept is left to the calibration.

    Only telling features take part; many weak words would otherwise outvote a telling one in a long text.
    """
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, index, often = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    n1, n0 = max(1, int(good.sum())), max(1, int((1 - good).sum()))
    in_good = np.bincount(index, good[which], len(used))
    active = telling(in_good, often - in_good, n1, n0)
    keep = active[index]
    which, index = which[keep], index[keep]
    weights, mean, square = (np.zeros(len(used) + 1) for _ in range(3))
    balance = np.where(good > 0, 0.5 * len(rows) / n1, 0.5 * len(rows) / n0) / len(rows)
    for step in range(1, steps + 1):
        error = (_sigmoid(np.bincount(which, weights[index], len(rows)) + weights[-1]) - good) * balance
        gradient = np.append(np.bincount(index, error[which], len(used)) + ridge * weights[:-1], error.sum())
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        weights -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    out = np.zeros(WIDTH, dtype=np.float32)
    out[used[active]] = weights[:-1][active]
    return out


def _scale(columns: np.ndarray, good: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression with intercept over few columns, by damped Newton steps."""
    x = np.column_stack([columns, np.ones(len(columns))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (good - p) - 1e-2 * w)
    return w


@dataclass
class Model:
    content: Linear
    metadata: Linear
    combine: np.ndarray


def handed(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log-odds weights of features from the (bad, good) pseudo-labelled rows that they stand in; 0 where they don't tell the classes apart."""
    if not rows.all():
        return np.zeros(WIDTH, dtype=np.float32)
    (bad, good), (n0, n1) = counts.astype(float), rows.astype(float)
    odds = np.log((good + 0.5) / (n1 + 1)) - np.log((bad + 0.5) / (n0 + 1))
    return np.where(telling(good, bad, n1, n0), odds, 0).astype(np.float32)


def calibrated(parts: list[np.ndarray], rows: list[np.ndarray], good: np.ndarray) -> Linear:
    """One linear view from weight vectors, by the slopes that fit the held-out rows."""
    columns = np.array([[w[r].sum() for w in parts] for r in rows], dtype=float)
    *slopes, shift = _scale(columns, good)
    return Linear(sum(np.float32(k) * w for k, w in zip(slopes, parts, strict=True)), 1.0, float(shift))


def split(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are fitted on, and which are held out: a fifth of each class, one row at least. The only row of a class is both."""
    rng, held = np.random.default_rng(SEED), np.zeros(len(good), dtype=bool)
    classes = [np.flatnonzero(good == label) for label in (0, 1)]
    for rows in classes:
        held[rng.choice(rows, max(1, round(len(rows) / 5)), replace=False)] = True
    seen = ~held
    seen[[rows[0] for rows in classes if len(rows) == 1]] = True
    return seen, held


def co_train(views: tuple[list, list], good: np.ndarray, exchange, rounds: int = ROUNDS) -> Model | None:
    """The model from labelled rows (both views and whether they are good); None without both classes.

    exchange(linear views) gives, for each view, what the other one hands it: (bad, good) counts of every
    feature, and of rows.
    """
    if len({*good.tolist()}) < 2:
        return None
    seen, held = split(good)
    train = [[v[i] for i in np.flatnonzero(seen)] for v in views]
    test, truth = [[v[i] for i in np.flatnonzero(held)] for v in views], good[held].astype(float)
    fitted = [fit(rows, good[seen].astype(float)) for rows in train]
    linear = [calibrated([fitted[v]], test[v], truth) for v in range(2)]
    for _ in range(rounds):
        got = exchange(linear)
        linear = [calibrated([fitted[v], handed(*got[v])], test[v], truth) for v in range(2)]
    x = np.array([[linear[v].logit(test[v][i]) for v in range(2)] for i in range(len(truth))])
    return Model(linear[0], linear[1], _scale(x, truth))


def packed(features: np.ndarray) -> bytes:
    """Features in ascending order, two bytes each: the beginnings of the upper three pages, then the places in them."""
    features = np.sort(features)
    return np.searchsorted(features, [1 << 16, 2 << 16, 3 << 16]).astype("<u4").tobytes() + (features & 0xFFFF).astype("<u2").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.frombuffer(raw, "<u2", offset=12).astype(np.int32)
    for at in np.frombuffer(raw, "<u4", 3):
        out[at:] += 1 << 16
    return out


def _columns(documents: DataFrame) -> DataFrame:
    has = lambda name, kind: F.col(name).cast(kind) if name in documents.columns else F.lit(None).cast(kind)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has("lang", "string").alias("lang"), has("source", "string").alias("source"), has("n_chars", "long").alias("n_chars"))


def extracted(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, good (null if not chosen), a and b (packed features of the views) of every row of documents."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = Content()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = part.to_pydict()
                a = [packed(content.features(t)) for t in rows["text"]]
                b = [packed(metadata_features(*m)) for m in zip(rows["lang"], rows["source"], rows["n_chars"], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows["good"], pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["doc_id", "good", "a", "b"])

    return _columns(documents).join(F.broadcast(chosen), "doc_id", "left").mapInArrow(run, "doc_id long, good int, a binary, b binary")


def logits(linear: Linear, rows: list[np.ndarray]) -> np.ndarray:
    """Of rows of one feature at least."""
    at = np.cumsum([0, *map(len, rows[:-1])])
    return linear.slope * np.add.reduceat(linear.weights[np.concatenate(rows)].astype(np.float64), at) + linear.shift


def exchanged(features: DataFrame, linear: list[Linear]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view the counts of what the other is sure of, over all rows without label."""
    shared = features.sparkSession.sparkContext.broadcast(linear)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros((2, 2, WIDTH), dtype=np.int64), np.zeros((2, 2), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                views = [[unpacked(x) for x in batch.slice(start, 256).column(c).to_pylist()] for c in ("a", "b")]
                for v in range(2):
                    p = _sigmoid(logits(shared.value[v], views[v]))
                    for label, sure in ((0, p <= 1 - SURE), (1, p >= SURE)):
                        rows[1 - v, label] += int(sure.sum())
                        for i in np.flatnonzero(sure).tolist():
                            counts[1 - v, label, views[1 - v][i]] += 1
        view, label, feature = np.nonzero(counts)
        n = np.r_[counts[view, label, feature], rows.ravel()]
        view, label, feature = np.r_[view, 0, 0, 1, 1], np.r_[label, 0, 1, 0, 1], np.r_[feature, -1, -1, -1, -1]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (view, label, feature, n)], ["view", "label", "feature", "n"])

    found = features.where("good is null").select("a", "b").mapInArrow(run, "view long, label long, feature long, n long")
    table = found.groupBy("view", "label", "feature").agg(F.sum("n").alias("n")).toArrow()  # at most 4 rows for each of WIDTH features
    view, label, feature, n = (table.column(c).to_numpy() for c in ("view", "label", "feature", "n"))
    counts, rows = np.zeros((2, 2, WIDTH), dtype=np.int64), np.zeros((2, 2), dtype=np.int64)
    whole = feature < 0
    rows[view[whole], label[whole]] = n[whole]
    counts[view[~whole], label[~whole], feature[~whole]] = n[~whole]
    return [(counts[v], rows[v]) for v in range(2)]


def train(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[Model | None, DataFrame | None]:
    """The model, and the features of all documents; None without labels of both kinds.

    Fitted on at most `labelled` labelled documents; of several texts of one doc_id on the one of least features. A label is good if quality is 1 and toxic is not; of several the worst holds.
    """
    rows = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good"))
    rows = rows.groupBy("doc_id").agg(F.min("good").alias("good"))
    chosen = rows.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(labelled).toPandas()
    if chosen["good"].nunique() < 2:
        return None, None
    chosen = documents.sparkSession.createDataFrame(list(zip(chosen["doc_id"].tolist(), chosen["good"].tolist(), strict=True)), "doc_id long, good int")  # at most `labelled` rows are broadcast
    features = cut(extracted(documents, chosen))
    table = features.where("good is not null").groupBy("doc_id", "good").agg(F.min_by("a", F.struct("a", "b")).alias("a"), F.min_by("b", F.struct("a", "b")).alias("b")).toArrow().sort_by([("doc_id", "ascending")]).to_pydict()
    views = tuple([unpacked(x) for x in table[c]] for c in "ab")
    return co_train(views, np.array(table["good"], dtype=int), lambda linear: exchanged(features, linear)), features


def _decided(a: list[np.ndarray], b: list[np.ndarray], model: Model) -> list[np.ndarray]:
    """Combined, content and metadata scores of rows."""
    x, y = logits(model.content, a), logits(model.metadata, b)
    return [_sigmoid(z) for z in (model.combine[0] * x + model.combine[1] * y + model.combine[2], x, y)]


def score(features: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, content_score, metadata_score, keep of every row of features."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                got = _decided(*([unpacked(x) for x in part.column(c).to_pylist()] for c in "ab"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, got), pa.array(got[0] >= 0.5)], ["doc_id", "score", "content_score", "metadata_score", "keep"])

    return features.mapInArrow(run, "doc_id long, score double, content_score double, metadata_score double, keep boolean")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all documents with a model co-trained on their labels.

    Null texts count as empty and null metadata as a value of its own; rows with null or repeated doc_id
    are scored like any other; without labels of both kinds every row is kept with null scores; empty
    tables give no rows; further columns are ignored.
    """
    model, features = train(documents, labels)
    if model is None:
        nothing = [F.lit(None).cast("double").alias(c) for c in ("score", "content_score", "metadata_score")]
        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), *nothing, F.lit(True).alias("keep"))
    return score(features, model)


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the classifier keeps, with all their columns."""
    model, _ = train(documents, labels)
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = Content()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [part.column(k).to_pylist() if k in names else [None] * part.num_rows for k in ("text", "lang", "source", "n_chars")]
                a, b = [content.features(t) for t in rows[0]], [metadata_features(*m) for m in zip(*rows[1:], strict=True)]
                yield part.filter(pa.array(_decided(a, b, shared.value)[0] >= 0.5))

    return documents.mapInArrow(run, documents.schema)
