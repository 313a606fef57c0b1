"""Personal data in score documents, by labelers whose reliability is learned without labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noteloom.llm.columns import plain, text_of
from noteloom.llm.shipping import map_arrow

#: Kinds in their order of writing; a secret is only ever added.
KINDS = ("email", "ip", "card", "phone", "secret")
WINDOW = 48
ROUNDS = 60

Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    doubled = [d if place % 2 == 0 else d * 2 - 9 * (d > 4) for place, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Addresses, found from each @ outwards, so that a long run without one costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            end = domain.end()
            yield start, end, "email"
        at = text.find("@", max(end, at + 1))


def _ips(text: str) -> Iterator[Span]:
    for found in _IP.finditer(text):
        parts = [part.lstrip("0") for part in found.group().split(".")]
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in parts):
            yield found.start(), found.end(), "ip"


def _cards(text: str) -> Iterator[Span]:
    for found in _CARD.finditer(text):
        digits = _digits(found.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield found.start(), found.end(), "card"


def _phones(text: str) -> Iterator[Span]:
    for found in _PHONE.finditer(text):
        if 9 <= len(_digits(found.group())) <= 15:
            yield found.start(), found.end(), "phone"


def base_spans(text: str) -> list[Span]:
    """Spans that the fixed rules give, by start and then kind."""
    spans = [*_emails(text), *_ips(text), *_cards(text), *_phones(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


_GROUP = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer with one :: in place of the zeros.
_IPV6 = "|".join([
    f"(?:{_GROUP}:){{7}}{_GROUP}",
    *(f"{_GROUP}(?::{_GROUP}){{{n - 1}}}::(?:{_GROUP}(?::{_GROUP}){{0,{6 - n}}})?" for n in range(1, 7)),
    f"{_GROUP}(?::{_GROUP}){{6}}::",
    f"::{_GROUP}(?::{_GROUP}){{0,6}}",
])
_CANDIDATES = {
    "email": re.compile(
        r"(?<![\w.])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}"
        r"(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,4}(?!\w)",
        re.I,
    ),
    "ip": re.compile(rf"(?<![\w:])(?:{_IPV6})(?!\w|:[\w:])"),
    "phone": re.compile(r"(?<![\w+.-])(?<!\+[0-9] )(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])"),
}
#: Text without these cannot hold a candidate of the kind.
_SIGNS = {"email": re.compile(r"[\[( ]at[\]) ]", re.I), "ip": re.compile(r":[0-9A-Fa-f]{0,4}:"),
          "phone": re.compile(r"[0-9][ .-][0-9]{3}"), "secret": re.compile(r"[0-9]")}
#: Words near a span of the kind.
GAZETTEER = {
    "email": frozenset("mail email e-mail contact write kontakt correo courriel".split()),
    "ip": frozenset("ip address host server addr ipv6 adresse".split()),
    "phone": frozenset("tel phone telephone mobile cell call fax telefon teléfono téléphone contact".split()),
    "secret": frozenset(
        "token secret password passwd pwd key apikey api_key api-key access_key auth authorization bearer credential credentials".split()
    ),
}
_SHAPES = {
    "email": re.compile(r".+(?:\(at\)|\[at\]).+(?:\(dot\)|\[dot\]).+", re.I),
    "ip": re.compile(rf"(?=.*[0-9])(?=(?:.*{_GROUP}\b){{3}})(?:{_IPV6})"),
    "phone": re.compile(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}"),
    "secret": re.compile(r"[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp|gho|sk|pk|xox[bp])[_-][A-Za-z0-9_-]{16,}"),
}
_WORD = re.compile(r"[^\W\d][\w-]*")


def _by_shape(kind: str, value: str) -> int:
    """The pattern labeler: strict forms speak for, words and plain numbers against."""
    if _SHAPES[kind].fullmatch(value):
        return 1
    if kind == "ip" and not re.search(r"[0-9]", value):
        return -1
    if kind == "secret" and (value.isalpha() or value.isdigit() or len(set(value)) < 6):
        return -1
    return 0


def _by_words(kind: str, before: str, after: str) -> int:
    """The gazetteer labeler: a word of the kind near the span speaks for it, words of other kinds against."""
    words = {word.lower() for word in _WORD.findall(before)} | {word.lower() for word in _WORD.findall(after)[:3]}
    if words & GAZETTEER[kind]:
        return 1
    return -1 if any(words & others for name, others in GAZETTEER.items() if name != kind) else 0


def _by_context(before: str, after: str) -> int:
    """The context labeler: assignments, colons and quotes speak for, paths and arithmetic against."""
    lead, tail = before.rstrip(" "), after.lstrip(" ")
    if lead[-1:] in ("=", ":", '"', "'", "<") or tail[:1] in ('"', "'", ">"):
        return 1
    if lead[-1:] in ("/", "\\", "#", "*", "$", "%") or tail[:1] in ("/", "*", "%", "$"):
        return -1
    return 0


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[Span, tuple[int, ...]]]:
    """Possible further spans and their features: kind, three votes, length, digits, case."""
    used = list(taken)
    for kind, sign in _SIGNS.items():
        if not sign.search(text):
            continue
        for found in _CANDIDATES[kind].finditer(text):
            start, end = found.span()
            value = found.group()
            if kind == "secret" and not (re.search(r"[0-9]", value) and re.search(r"[A-Za-z]", value)):
                continue
            if any(start < stop and begin < end for begin, stop, _ in used):
                continue
            before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
            votes = _by_shape(kind, value), _by_words(kind, before, after), _by_context(before, after)
            share = 4 * sum("0" <= c <= "9" for c in value) // len(value)
            mixed = int(value.lower() != value and value.upper() != value)
            features = (KINDS.index(kind), *votes, min(len(value) // 16, 4), share, mixed)
            used.append((start, end, kind))
            yield (start, end, kind), features


@dataclass(frozen=True)
class SpanModel:
    """Weights of the final classifier over one-hot features, and what the labelers are worth."""

    weights: np.ndarray
    reliability: np.ndarray

    def probability(self, features: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-(_one_hot(np.array([features])) @ self.weights)[0])))


_FEATURES = ("kind", "shape", "words", "context", "length", "digits", "mixed")
_SIZES = (len(KINDS), 3, 3, 3, 5, 5, 2)


def _one_hot(rows: np.ndarray) -> np.ndarray:
    rows = rows + np.array([0, 1, 1, 1, 0, 0, 0])
    columns = [np.eye(size)[rows[:, place]] for place, size in enumerate(_SIZES)]
    return np.column_stack([*columns, np.ones(len(rows))])


def learn(rows: np.ndarray, counts: np.ndarray) -> SpanModel:
    """Expectation-maximisation over vote patterns, then a logistic classifier on its posteriors.

    Each labeler has a probability of each vote for true and for false spans;
    they start in favour of the labelers and the votes of all are independent given the truth.
    """
    votes, counts = rows[:, 1:4] + 1, counts.astype(float)
    given = np.tile(np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])[:, None, :], (1, 3, 1))  # class, labeler, vote
    prior = 0.5
    posterior = np.full(len(rows), 0.5)
    for _ in range(ROUNDS):
        chance = np.stack([given[c][np.arange(3), votes].prod(1) for c in (0, 1)])
        posterior = prior * chance[1] / np.maximum(prior * chance[1] + (1 - prior) * chance[0], 1e-300)
        for c, share in ((0, 1 - posterior), (1, posterior)):
            for labeler in range(3):
                seen = np.bincount(votes[:, labeler], counts * share, 3) + np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])[c]
                given[c, labeler] = seen / seen.sum()
        prior = float((counts @ posterior + 1) / (counts.sum() + 2))
    data = _one_hot(rows)
    weights = np.zeros(data.shape[1])
    share = counts / max(counts.sum(), 1.0)
    for _ in range(800):
        chance = 1 / (1 + np.exp(-(data @ weights)))
        weights -= 2.0 * (data.T @ (share * (chance - posterior)) + 1e-4 * weights)
    return SpanModel(weights, given)


def fit(scores: DataFrame) -> SpanModel:
    """Learn the span model from the candidates of all score documents (piece_id, content).

    Only counts of feature patterns leave Spark, at most the product of the
    features' sizes. Without candidates the model rejects every span.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = map(pa.StringScalar.as_py, batch.column(0))
            found = [f for text in texts for _, f in candidates(text, base_spans(text))]
            columns = zip(*found, strict=True) if found else [[] for _ in _FEATURES]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], list(_FEATURES))

    texts = plain(scores, "piece_id", "content").select(text_of().alias("content"))
    patterns = map_arrow(texts, run, ", ".join(f"{name} int" for name in _FEATURES))
    table = patterns.groupBy(*_FEATURES).agg(F.count("*").alias("n")).toPandas()
    if table.empty:
        none = np.zeros(sum(_SIZES) + 1)
        none[-1] = -10.0
        return SpanModel(none, np.zeros((2, 3, 3)))
    table = table.sort_values(list(_FEATURES))
    return learn(table[list(_FEATURES)].to_numpy(), table["n"].to_numpy())


def spans_of(text: str, model: SpanModel) -> tuple[list[Span], list[Span]]:
    """Base spans of a text, and all spans."""
    base = base_spans(text)
    added = [span for span, features in candidates(text, base) if model.probability(features) > 0.5]
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(scores: DataFrame, model: SpanModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """Personal data in the whole content of every score document (piece_id, content).

    Returns ``piece_id``, the columns named in ``carry``, ``base`` and ``spans``
    (kind:start:end in code points, end exclusive, by start, then kind, comma-joined), the
    numbers ``n_email``, ``n_ip``, ``n_card`` and ``n_phone`` of base spans, and ``redacted``,
    the content with all spans replaced. Base spans always stay; the model adds others where they
    do not overlap. Null content is empty and has none; rows are independent of each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("content")
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column(at):
                text = text.as_py()
                base, spans = spans_of(text, model)
                kinds = [kind for _, _, kind in base]
                row = [written(base), written(spans), *(kinds.count(kind) for kind in KINDS[:4]), redacted(text, spans)]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "content"]
            types = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*[c for _, c in kept], *[pa.array(c, t) for c, t in zip(out, types, strict=True)]],
                [*[n for n, _ in kept], "base", "spans", "n_email", "n_ip", "n_card", "n_phone", "redacted"],
            )

    work = plain(scores, "piece_id", "content", *carry).withColumn("content", text_of())
    fields = StructType([f for f in work.schema.fields if f.name != "content"])
    fields = fields.add("base", "string").add("spans", "string")
    for name in ("n_email", "n_ip", "n_card", "n_phone"):
        fields = fields.add(name, "long")
    return map_arrow(work, run, fields.add("redacted", "string"))
