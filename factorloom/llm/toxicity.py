"""Toxicity by a chain of linear classifiers.

The label columns are predicted in a fixed order. Each model sees the words and word beginnings that tell its
classes apart, and the probabilities of the categories before it. While training, those probabilities are out of
fold, so that a later model learns how far it can trust them. Models are fitted on a bounded sample of labelled
rows; scoring runs over every document where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WordHasher, checkpoint, portions, table

#: Labelled rows that the models are fitted on, at most; features that each category may choose; folds.
SAMPLE, FEATURES, FOLDS = 20_000, 1024, 3
PREFIXES = (4, 5, 6, 7, 8)
BETWEEN = bytes(b for b in range(128) if not chr(b).isalnum())
#: Log-likelihood gain that a feature must bring; by chance one in twenty thousand does.
LEAST_GAIN = 9.0

_hasher: list[WordHasher] = []


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs: words, and beginnings of words of PREFIXES bytes."""
    if not _hasher:
        _hasher.append(WordHasher(BETWEEN))
    hashes, counts, cut = _hasher[0].words(texts, PREFIXES)
    owner = np.repeat(np.arange(len(texts)), counts)
    return np.tile(owner, 1 + len(cut)), np.concatenate([hashes, *cut])


def distinct(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, owner))
    owner, feature = owner[order], feature[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1])
    return owner[new], feature[new]


def as_bytes(texts: list[str]) -> list[bytes]:
    return [t.encode(errors="surrogatepass") for t in texts]


@dataclass
class Linear:
    """A logistic model over a sorted list of feature hashes, and the probabilities of earlier categories."""

    known: np.ndarray
    weights: np.ndarray
    bias: float
    earlier: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, owner: np.ndarray, feature: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        """Probabilities of n texts from their distinct (owner, feature) pairs."""
        z = np.full(n, self.bias) + (earlier @ self.earlier if len(self.earlier) else 0.0)
        if len(self.known) and len(feature):
            at = np.minimum(np.searchsorted(self.known, feature), len(self.known) - 1)
            hit = self.known[at] == feature
            z += np.bincount(owner[hit], self.weights[at[hit]], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(known: np.ndarray, owner: np.ndarray, index: np.ndarray, earlier: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 2e-5) -> Linear:
    """Minimise the mean log loss plus l2 * weights squared by Adam; (owner, index) are the features present."""
    n, m, extra = len(y), len(known), earlier.shape[1]
    rate = np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3)
    theta = np.zeros(m + extra + 1)
    theta[-1] = np.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        return Linear(known, theta[:m], theta[-1], theta[m:-1])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = np.bincount(owner, theta[index], minlength=n) + earlier @ theta[m:-1] + theta[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        slope = np.concatenate([np.bincount(index, error[owner], minlength=m), earlier.T @ error, [error.sum()]]) / n
        slope[:-1] += l2 * theta[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Linear(known, theta[:m], float(theta[-1]), theta[m:-1])


def _counted(sample: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(feature, n, one count of positive texts per category), summed before and after the shuffle."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch, 0):
                flags = [np.array(part.column(1 + i).to_pylist(), dtype=float) == 1 for i in range(len(categories))]
                owner, feature = distinct(*features(as_bytes(texts)))
                values, at = np.unique(feature, return_inverse=True)
                counts = [np.bincount(at, minlength=len(values))] + [np.bincount(at, f[owner], minlength=len(values)) for f in flags]
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts)], names)

    names = ["feature", "n", *(f"y{i}" for i in range(len(categories)))]
    rows = sample.select("text", *categories).mapInArrow(apply, ", ".join(f"{c} long" for c in names))
    return rows.groupBy("feature").agg(*(F.sum(c).alias(c) for c in names[1:]))


def _chosen(counted: DataFrame, i: int, positive: int, total: int, limit: int) -> np.ndarray:
    """The features with the largest gain of information on category i: at most ``limit``."""
    rate = positive / total

    def part(k, n, share):
        return F.when(k > 0, k * F.log((k + 0.5) / (n * share + 0.5))).otherwise(0.0)

    k, n = F.col(f"y{i}"), F.col("n")
    gain = part(k, n, rate) + part(n - k, n, 1 - rate)
    rows = counted.select("feature", gain.alias("gain")).where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "feature").limit(limit)
    return np.sort(np.array([r.feature for r in rows.collect()], dtype=np.int64).view(U64))


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE, limit: int = FEATURES, folds: int = FOLDS) -> list[Linear]:
    """One model per category, in order. docs: (id, text); labels: (id, categories of 0 or 1).

    Fitted on at most ``sample`` labelled rows, those with the smallest hash of their id. Rows without all labels don't
    count; an id with several labels takes the largest of each category.
    """
    labels = labels.na.drop().groupBy("id").agg(*(F.max(c).alias(c) for c in categories))
    chosen = labels.orderBy(F.xxhash64("id"), "id").limit(sample)
    part = checkpoint(docs.join(F.broadcast(chosen), "id").select("id", "text", *categories))
    counted = checkpoint(_counted(part, categories))
    sums = part.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in categories)).first()
    known = [_chosen(counted, i, sums[c] or 0, max(sums["n"], 1), limit) for i, c in enumerate(categories)]
    every = np.unique(np.concatenate(known))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch, 1):
                owner, feature = matching(as_bytes(texts), every)
                places = np.searchsorted(every, feature).astype("<u2")
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                rows = [places[i:j].tobytes() for i, j in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), pa.array(rows, pa.binary()), *(part.column(2 + i).cast(pa.int32()) for i in range(len(categories)))], ["id", "places", *categories])

    schema = "id string, places binary, " + ", ".join(f"`{c}` int" for c in categories)
    found = part.mapInArrow(present, schema).toArrow().sort_by([("id", "ascending"), ("places", "ascending"), *((c, "ascending") for c in categories)])
    n = found.num_rows
    places = found.column("places").to_pylist()
    owner = np.repeat(np.arange(n), [len(p) // 2 for p in places])
    feature = every[np.frombuffer(b"".join(places), dtype="<u2")]
    fold = np.random.default_rng(0).permutation(n) % folds
    earlier, models = np.zeros((n, 0)), []
    for i, category in enumerate(categories):
        y = found.column(category).to_numpy().astype(float)
        at = np.minimum(np.searchsorted(known[i], feature), max(len(known[i]) - 1, 0))
        hit = known[i][at] == feature if len(known[i]) else np.zeros(len(feature), dtype=bool)
        o, f = owner[hit], at[hit]
        outside = np.zeros(n)
        for k in range(folds):
            inside = fold != k
            number = np.cumsum(inside) - 1
            keep = inside[o]
            model = fit(known[i], number[o[keep]], f[keep], earlier[inside], y[inside])
            outside[~inside] = model.score(owner, feature, n, earlier)[~inside]
        models.append(fit(known[i], o, f, earlier, y))
        earlier = np.column_stack([earlier, outside])
    return models


def matching(texts: list[bytes], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, feature) pairs whose feature is known, in order of the texts."""
    owner, feature = features(texts)
    if not len(known):
        return owner[:0], feature[:0]
    table_ = np.zeros(1 << 20, dtype=bool)
    table_[(known & U64((1 << 20) - 1)).astype(np.int64)] = True
    maybe = table_[(feature & U64((1 << 20) - 1)).astype(np.int64)]
    owner, feature = owner[maybe], feature[maybe]
    hit = known[np.minimum(np.searchsorted(known, feature), len(known) - 1)] == feature
    return distinct(owner[hit], feature[hit])


def score(docs: DataFrame, text_col: str, models: list[Linear], names: Sequence[str]) -> DataFrame:
    """docs plus one probability column per model; text_col is a string."""
    every = np.unique(np.concatenate([m.known for m in models]))
    kinds = [f.dataType.simpleString() for f in docs.schema.fields]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch, batch.schema.get_field_index(text_col)):
                owner, feature = matching(as_bytes(texts), every)
                found = np.zeros((len(texts), 0))
                for m in models:
                    found = np.column_stack([found, m.score(owner, feature, len(texts), found)])
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[:, i]) for i in range(len(models)))], [*part.schema.names, *names])

    schema = ", ".join(f"`{f}` {k}" for f, k in zip(docs.columns, kinds)) + "".join(f", `{c}` double" for c in names)
    return docs.mapInArrow(apply, schema)


def toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, whole: bool = False, **options) -> DataFrame:
    """One row per row of docs: its id, p_<category> for each category of the chain, and toxic (the last one >= threshold).

    With ``whole`` all columns of docs come instead of the id alone (columns named like the new ones give way).
    labels has the id and a column of 0 or 1 per category; rows with a null in any of them are not used. With no
    usable labels, or one class only, probabilities are near the rate that was seen and clamped to 0.001 ... 0.999.
    A null text counts as empty. Rows may repeat; empty tables give no rows.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    models = train(texts, labels.select(F.col(id_col).alias("id"), *categories), categories, **options)
    names = [f"p_{c}" for c in categories]
    new = [*names, "toxic", "__text"]
    kept = [c for c in docs.columns if c not in new] if whole else [id_col]
    if text_col in kept and dict(docs.dtypes)[text_col] == "string":
        scored = score(docs.select(*kept), text_col, models, names)
    else:
        scored = score(docs.select(*kept, F.col(text_col).cast("string").alias("__text")), "__text", models, names).drop("__text")
    return scored.withColumn("toxic", F.col(names[-1]) >= threshold)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
