"""Toxicity by multiple-instance learning: a document is a bag of sentences, and only documents have labels.

A sentence's score is a logistic function of the words and word beginnings in
it; a document is toxic unless none of its sentences is, a noisy-or with a small
leak for what no sentence explains.  The weights are trained from document
labels through that noisy-or, so that the sentences which explain the labels
get them, and scoring locates these sentences.

Features are whole words and the first 3 to 8 characters of longer ones, chosen
by their association with the label.  A sentence without a chosen feature has
score 0, so a long harmless text does not add up to a toxic one.

Choice and fit use at most SAMPLE labelled documents, drawn by a digest of
their id, each text once; scoring covers all rows, in one pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planlens.llm.common import remainder, store, text_steps, whole_text

#: Labelled documents that the fit uses at most, and features that it weighs at most.
SAMPLE, FEATURES = 20_000, 8192
#: A feature occurs in so many documents at least and is so many standard deviations more frequent in toxic ones.
LEAST_DOCUMENTS, LEAST_DEVIATION = 3, 4.0
SHORTEST, LONGEST = 3, 8
RIDGE, RATE, STEPS = 0.05, 0.1, 300
SENTENCE = re.compile(r"[^.!?。！？\n]+")
WORD = re.compile(r"\w+")
#: Score from which a document counts as toxic, and from which a sentence is located.
TOXIC, OFFENDING = 0.3, 0.5
#: Entries of a task's memory of words, and features counted before they are passed on.
HELD = 1 << 18


def features_of(word: str) -> list[str]:
    """The word and its beginnings, which end in a star."""
    return [word, *[word[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)]]


@dataclass
class Evidence:
    """Finds the known features of words and sentences; remembers words up to a bound."""

    known: dict[str, int]
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self):
        self.heads = {f[:SHORTEST] for f in self.known}

    def of_word(self, word: str) -> tuple[int, ...]:
        if word[:SHORTEST] not in self.heads:
            return ()
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= HELD:
                self.seen.clear()
            found = self.seen[word] = tuple(self.known[f] for f in features_of(word) if f in self.known)
        return found

    def of_text(self, text: str) -> Iterator[tuple[int, int, list[int]]]:
        """(start, end, features) of the sentences that have any."""
        hits = {w for w in set(WORD.findall(text.lower())) if self.of_word(w)}
        if not hits:
            return
        for m in SENTENCE.finditer(text):
            words = hits.intersection(WORD.findall(m[0].lower()))
            if words:
                yield m.start(), m.end(), sorted({f for w in words for f in self.of_word(w)})


@dataclass(frozen=True)
class Model:
    features: list[str]
    weights: list[float]
    bias: float
    leak: float

    def document(self, sentences: np.ndarray) -> float:
        """Noisy-or of sentence scores."""
        return float(1 - (1 - self.leak) * np.prod(1 - sentences))

    def sentence(self, features: list[int]) -> float:
        return float(1 / (1 + np.exp(-(self.bias + sum(self.weights[f] for f in features)))))


def fit(bags: list[list[list[int]]], y: np.ndarray, features: list[str]) -> Model:
    """Weights, bias and leak by gradient steps on the documents' log likelihood.

    ``bags`` has the feature lists of each document's sentences.  Let q be the
    probability that a document is harmless, the product of (1 - leak) and its
    sentences' 1 - p: the slope with regard to a sentence's logit is p where the
    label is 0 and -p q / (1 - q) where it is 1.  One class alone gives a
    model without weights.
    """
    base = (y.sum() + 0.5) / (len(y) + 1.0)
    if not features or not 0 < y.sum() < len(y):
        return Model([], [], 0.0, float(base))
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    flat = [s for b in bags for s in b]
    sentence = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    entry = np.array([f for s in flat for f in s], dtype=np.int64)
    k = len(features)
    theta = np.zeros(k + 2)  # weights, bias, logit of the leak
    theta[k:] = -1.0, -4.0
    first, second = np.zeros(k + 2), np.zeros(k + 2)
    for step in range(1, STEPS + 1):
        logit = theta[k] + np.bincount(sentence, theta[entry], len(flat))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        leak = 1 / (1 + np.exp(-theta[k + 1]))
        log_q = np.log1p(-leak) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags))
        q = np.minimum(np.exp(log_q), 1 - 1e-9)
        pull = np.where(y == 1, -q / (1 - q), 1.0)  # minus the slope by log q
        by_logit = pull[doc] * p
        slope = np.concatenate(
            [np.bincount(entry, by_logit[sentence], k) + RIDGE * theta[:k], [by_logit.sum()], [(pull * leak).sum()]]
        )
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        theta[k + 1] = min(theta[k + 1], np.log(base / (1 - base)))  # the leak explains at most the base rate
    return Model(features, theta[:k].tolist(), float(theta[k]), float(1 / (1 + np.exp(-theta[k + 1]))))


def _taught(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, sample: int) -> DataFrame:
    """(_y, text) of at most ``sample`` labelled documents, equal texts once; of several labels the largest counts."""
    digest = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).where(
        "_id is not null and _y is not null"
    )
    known = known.where(remainder(F.col("_id"), modulus) != held_out).groupBy("_id").agg(F.max("_y").alias("_y"))
    share = min(1.0, 1.1 * sample / max(1, known.count()))
    drawn = known.where(digest < int(share * (1 << 30))).orderBy(digest, "_id").limit(sample)
    found = docs.join(F.broadcast(drawn), docs.doc_id == drawn._id)  # ``sample`` rows at most
    texts = found.select("_y", whole_text(F.col("text")).alias("text"))
    chosen = texts.groupBy(F.xxhash64("text").alias("_h"), "text").agg(F.max("_y").alias("_y"))
    # in as many parts as a shuffle has, whatever their bytes: each text is read word by word twice
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taught = store(chosen.repartition(parts, "_h"), "taught")
    if taught.count() > sample:  # ids that repeat can bring more texts than ids
        last = taught.select("_h").orderBy("_h").offset(sample - 1).limit(1).first()[0]
        taught = taught.where(F.col("_h") <= last)
    return taught.select("_y", "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and toxic documents of each feature, in parts."""
    n, toxic = Counter(), Counter()

    def part() -> pa.RecordBatch:
        names = list(n)
        columns = [pa.array(names, pa.string()), pa.array([n[f] for f in names], pa.int64()), pa.array([toxic[f] for f in names], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["feature", "n", "t"])

    for batch in batches:
        for piece, texts in text_steps(batch):
            for text, y in zip(texts, piece.column("_y").to_pylist(), strict=True):
                found = {f for w in set(WORD.findall(text.decode("utf-8", "replace").lower())) for f in features_of(w)}
                n.update(found)
                if y:
                    toxic.update(found)
                if len(n) > HELD:
                    yield part()
                    n.clear()
                    toxic.clear()
    yield part()


def fit_labelled(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, sample: int = SAMPLE) -> Model:
    """Fit on ``docs`` (doc_id, text) with a label (doc_id, toxic) whose crc32(doc_id) modulo ``modulus`` is not ``held_out``.

    Missing labels and ids teach nothing.  The driver holds the features of the
    drawn documents' sentences that have any.
    """
    taught = _taught(docs, labels, modulus, held_out, sample)
    rows, positive = taught.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not 0 < positive < rows:
        return fit([], np.concatenate([np.ones(positive), np.zeros(rows - positive)]), [])
    rate = positive / rows
    counts = taught.mapInArrow(_counted, "feature string, n bigint, t bigint").groupBy("feature")
    totals = counts.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") >= LEAST_DOCUMENTS)
    deviation = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    ranked = totals.select("feature", deviation.alias("z")).where(F.col("z") >= LEAST_DEVIATION).orderBy(F.desc("z"), "feature")
    features = [r.feature for r in ranked.limit(FEATURES).collect()]
    known = {f: i for i, f in enumerate(features)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(known)
        for batch in batches:
            for piece, texts in text_steps(batch):
                found = [[f for _, _, f in evidence.of_text(t.decode("utf-8", "replace"))] for t in texts]
                yield pa.RecordBatch.from_arrays([piece.column("_y"), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["_y", "bag"])

    got = taught.mapInArrow(bags, "_y int, bag array<array<int>>").toArrow()
    return fit(got.column("bag").to_pylist(), np.array(got.column("_y").to_pylist(), dtype=float), features)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Columns ``keep`` with score, n_sentences and ``offending``: (start, end, score) of the sentences of OFFENDING or more.

    Offsets count code points of the text.  A missing text is empty; a text
    without known features has the leak as its score; a very long text is read
    sentence by sentence.
    """
    known = {f: i for i, f in enumerate(model.features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(known)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for piece, texts in text_steps(batch):
                scores, counts, located = [], [], []
                for raw in texts:
                    text = raw.decode("utf-8", "replace")
                    found = [(a, b, model.sentence(f)) for a, b, f in evidence.of_text(text)]
                    scores.append(model.document(np.array([p for _, _, p in found])))
                    counts.append(sum(not m[0].isspace() for m in SENTENCE.finditer(text)))
                    located.append([{"start": a, "end": b, "score": p} for a, b, p in found if p >= OFFENDING])
                columns = [piece.column("_kept"), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(located, spans)]
                yield pa.RecordBatch.from_arrays(columns, names=["_kept", "score", "n_sentences", "offending"])

    rows = docs.select(F.struct(*keep).alias("_kept"), whole_text(F.col("text")).alias("text"))
    kept = rows.schema["_kept"].dataType.simpleString()
    made = f"_kept {kept}, score double, n_sentences bigint, offending array<struct<start:bigint,end:bigint,score:double>>"
    return rows.mapInArrow(run, made).select("_kept.*", "score", "n_sentences", "offending")


def classify(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, offending for every row of ``docs`` (doc_id, text; others are ignored).

    Labels count only where crc32(doc_id) modulo ``modulus`` is not
    ``held_out``.  Repeated rows are scored alike; an empty table gives an empty
    one; without usable labels all scores are the base rate.
    """
    model = fit_labelled(docs.select("doc_id", "text"), labels, modulus, held_out)
    scored = score(docs, model, "doc_id")
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        "n_sentences",
        "offending",
    )
