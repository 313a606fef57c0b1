"""Language of a score's text by sparse multinomial regression on character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noteloom.llm.columns import plain
from noteloom.llm.shipping import map_arrow

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_ROWS = 4096
UNKNOWN = "und"

_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(point).isalpha() for point in range(sys.maxunicode + 1)])


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the n-grams of a text; what is not a letter is one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, 32)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one space after each word
    points = points[kept]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0)
    points = np.concatenate([np.array([32], np.uint32), points, np.array([32], np.uint32)[: int(letter[-1])]])
    total = np.zeros(BUCKETS, np.int64)
    with np.errstate(over="ignore"):
        for order in ORDERS:
            if len(points) < order:
                break
            last = len(points) - order + 1
            mixed = np.full(last, order, np.uint32)
            for place in range(order):
                mixed = (mixed ^ points[place : place + last]) * np.uint32(_MULTIPLIERS[place])
                mixed ^= mixed >> np.uint32(15)
            total += np.bincount(mixed & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used, total[used].astype(float)


def weighted(used: np.ndarray, number: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of length one; term frequency is damped by a logarithm."""
    values = (1 + np.log(number)) * idf[used]
    return values / max(np.sqrt(values @ values), 1e-12)


@dataclass
class FollowTheLeader:
    """Multinomial logistic regression, follow-the-regularised-leader with elastic net."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    lasso: float = 0.02
    ridge: float = 0.05
    sums: np.ndarray = field(init=False)
    squares: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.sums = np.zeros((self.classes, BUCKETS))
        self.squares = np.zeros((self.classes, BUCKETS))

    def weights(self, used: np.ndarray | slice) -> np.ndarray:
        sums = self.sums[:, used]
        rate = (self.beta + np.sqrt(self.squares[:, used])) / self.alpha + self.ridge
        return np.where(np.abs(sums) > self.lasso, (np.sign(sums) * self.lasso - sums) / rate, 0.0)

    def learn(self, used: np.ndarray, values: np.ndarray, label: int) -> None:
        weights = self.weights(used)
        error = softmax(weights @ values)
        error[label] -= 1
        slope = error[:, None] * values
        before = self.squares[:, used]
        after = before + slope * slope
        self.sums[:, used] += slope - (np.sqrt(after) - np.sqrt(before)) / self.alpha * weights
        self.squares[:, used] = after


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(-1, keepdims=True))
    return raised / raised.sum(-1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        used, number = counts(text or "")
        if not len(used) or not self.languages:
            return UNKNOWN, 0.0
        chances = softmax(self.weights[:, used] @ weighted(used, number, self.idf) / self.temperature)
        best = int(np.argmax(chances))
        return self.languages[best], float(chances[best])


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which held-back labels are likeliest.

    One label in their number plus two counts as wrong (the rule of succession), else a sample without
    errors would make every answer certain.
    """
    doubt = 1 / (len(labels) + 2)
    target = np.full(logits.shape, doubt / max(logits.shape[1] - 1, 1))
    target[np.arange(len(labels)), labels] = 1 - doubt
    grid = np.exp(np.linspace(np.log(0.02), np.log(5.0), 80))
    loss = [-(target * np.log(np.maximum(softmax(logits / t), 1e-12))).sum(1).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        for text in batch.column(0):
            total[counts(text.as_py() or "")[0]] += 1
            total[BUCKETS] += 1
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of the texts, copies of a text in a task once for each language. Six bytes an n-gram: a bucket fits 16 bits."""
    known: set[tuple[str, int, int]] = set()
    for batch in batches:
        keys = list(zip(*(batch.column(at).to_pylist() for at in range(3)), strict=True))
        new = [row for row, key in enumerate(keys) if key not in known and not known.add(key)]
        found = [counts(batch.column(3)[row].as_py() or "") for row in new]
        arrays = [
            *(batch.column(at).take(pa.array(new, pa.int64())) for at in range(3)),
            pa.array([u.astype(np.int16) for u, _ in found], pa.list_(pa.int16())),
            pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["language", "hi", "lo", "used", "number"])


def _quotas(many: dict[str, int], max_rows: int) -> dict[str, int]:
    """Rows of each language: an even share, and what the small ones leave goes to the others."""
    quotas, left = {}, max_rows
    for place, name in enumerate(sorted(many, key=lambda name: (many[name], name))):
        quotas[name] = min(many[name], left // (len(many) - place))
        left -= quotas[name]
    return quotas


def fit(scores: DataFrame, labelled: DataFrame, max_rows: int = MAX_ROWS, passes: int = 4) -> LanguageModel:
    """Learn the languages of score texts.

    Document frequencies come from every row of ``scores`` (content). The classifier
    sees at most ``max_rows`` different texts of ``labelled`` (content, language), chosen by a hash of the
    content, evenly over the languages; copies of a text count once, null languages are left out. A fifth of
    them is held back to calibrate the temperature. Without labelled rows everything is ``und``.
    """
    texts = plain(scores, "content").select(F.col("content").cast("string"))
    table = map_arrow(texts, _document_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(BUCKETS + 1)
    frequency[table["bucket"].to_numpy()] = table["n"].to_numpy()
    idf = np.log((1 + frequency[BUCKETS]) / (1 + frequency[:BUCKETS])) + 1

    named = plain(labelled, "content", "language").filter(F.col("language").isNotNull() & F.col("content").isNotNull())
    # Copies of a text share both hashes.
    named = named.select(
        F.col("language").cast("string"),
        F.xxhash64("content").alias("hi"),
        F.xxhash64(F.lit(1), "content").alias("lo"),
        F.col("content").cast("string"),
    )
    key = ["language", "hi", "lo"]
    many = {row["language"]: row["count"] for row in named.select(*key).distinct().groupBy("language").count().collect()}
    languages = tuple(sorted(many))
    if not languages:
        return LanguageModel((), idf, np.zeros((0, BUCKETS)), 1.0)
    quotas = _quotas(many, max_rows)
    # A few more than the quota, for the draw is by chance.
    share = {name: min(1.0, (1.2 * quotas[name] + 16) / n) for name, n in many.items()}
    limits = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    drawn = named.filter(F.pmod("hi", F.lit(1 << 30)) < limits[F.col("language")] * (1 << 30))
    rows = map_arrow(drawn, _examples, "language string, hi long, lo long, used array<short>, number array<int>")
    # The driver holds the sample as it came, and of a text's values those of the one that is learned.
    sample = rows.dropDuplicates(key).toArrow()
    ordered = pc.sort_indices(sample.select(["lo", "hi", "language"]), [(name, "ascending") for name in ("lo", "hi", "language")])
    left = dict(quotas)
    examples = []
    for row in ordered.to_pylist():
        language = sample["language"][row].as_py()
        left[language] -= 1
        if left[language] < 0:
            continue
        places, number = (sample[name][row].values.to_numpy() for name in ("used", "number"))
        if len(places):
            examples.append((places, number, languages.index(language)))
    held = examples[::5] if len(examples) >= 20 else examples
    learned = [e for n, e in enumerate(examples) if n % 5] if len(examples) >= 20 else examples
    model = FollowTheLeader(len(languages))
    for _ in range(passes):
        for places, number, label in learned:
            model.learn(places, weighted(places, number, idf), label)
    weights = model.weights(slice(None))
    temperature = 1.0
    if held:
        logits = np.stack([weights[:, places] @ weighted(places, number, idf) for places, number, _ in held])
        temperature = _temperature(logits, np.array([label for *_, label in held]))
    return LanguageModel(languages, idf, weights, temperature)


def predict(scores: DataFrame, model: LanguageModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """The language of the whole content of every score document (piece_id, content).

    Returns ``piece_id``, the columns named in ``carry``, ``language_found`` and ``score``, the calibrated
    probability of that language. Content that is null or has no letter is ``und`` with score 0. Rows are independent.
    ``carry`` may name ``content``.
    """
    shared = scores.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("content")
            found = [learned.predict(text.as_py()) for text in batch.column(at)]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n in named]
            yield pa.RecordBatch.from_arrays(
                [*[c for _, c in kept], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*[n for n, _ in kept], "language_found", "score"],
            )

    named = ("piece_id", *carry)
    work = plain(scores, *dict.fromkeys((*named, "content"))).withColumn("content", F.col("content").cast("string"))
    fields = StructType([f for f in work.schema.fields if f.name in named])
    return map_arrow(work, run, fields.add("language_found", "string").add("score", "double"))
