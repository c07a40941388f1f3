"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from labels of whole documents."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, stored

#: Score from which a document is called toxic; a sentence offends from an even chance on.
THRESHOLD = 0.7
#: Labelled documents of each label that are learned from, and their words (once a sentence) in all: the bound of what one task holds.
SAMPLE, SAMPLE_WORDS = 6000, 2_000_000
#: Documents of the sample that a feature must be in, and the log-likelihood ratio that it must reach.
MIN_DOCS, EVIDENCE = 4, 14.0
#: Lengths of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6, 7)
EPOCHS, RATE, DECAY = 400, 0.1, 3e-5
_SENTENCE, _WORD = re.compile(r"[^.!?\n]+"), re.compile(r"[^\W\d_]+")
#: Words whose weights a task keeps.
_CACHE = 1 << 18


def sentences(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, words) of the sentences of ``text`` that have words, lower-cased."""
    for m in _SENTENCE.finditer(text or ""):
        if words := set(_WORD.findall(m.group().lower())):
            yield m.start(), m.end(), words


def features(word: str) -> list[str]:
    """The word, marked as whole, and its beginnings."""
    return [word + "$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


def held_out(doc_id: Column | None = None) -> Column:
    """Whether a document's label is not learned from."""
    return crc_of_id(3, doc_id) == 1


def telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Whether features, in so many documents of each label, tell the labels apart: the log-likelihood ratio against one common rate is EVIDENCE or more."""

    def part(k: np.ndarray, n: int) -> np.ndarray:
        p, rate = k / max(n, 1), (toxic + clean) / max(n_toxic + n_clean, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(k * np.log(p / rate)) + np.nan_to_num((n - k) * np.log((1 - p) / (1 - rate)))

    return (2 * (part(toxic, n_toxic) + part(clean, n_clean)) >= EVIDENCE) & (toxic + clean >= MIN_DOCS)


def learn(docs: list[list[list[str]]], labels: np.ndarray, weights: np.ndarray) -> tuple[dict[str, float], float]:
    """(weight of each feature, bias) from ``docs``, each a list of sentences' words, none of them empty.

    With z the bias and the weights of a sentence's words, a sentence offends with the chance p = 1 / (1 + exp(-z)), and a
    document is toxic if any sentence offends: 1 - prod(1 - p) = 1 - exp(-A), A = sum(log(1 + exp(z))). The
    weighted likelihood of the documents' labels is climbed by Adam; weights decay towards 0.
    """
    words = sorted({w for d in docs for s in d for w in s})
    number = {w: i for i, w in enumerate(words)}
    entry = np.array([number[w] for d in docs for s in d for w in s], dtype=np.int64)
    own_sentence = np.repeat(np.arange(sum(len(d) for d in docs)), [len(s) for d in docs for s in d])
    doc_first = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]]).astype(np.int64)
    sentence_doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    own_doc = sentence_doc[own_sentence]
    names = sorted({f for w in words for f in features(w)})
    index = {f: i for i, f in enumerate(names)}
    pairs = np.array([(number[w], index[f]) for w in words for f in features(w)], dtype=np.int64)
    in_doc = np.unique(own_doc * len(words) + entry)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
    of_doc, word = np.divmod(in_doc, len(words))
    size = np.diff(starts)[word]
    at = np.repeat(starts[word] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    held = np.unique(np.repeat(of_doc, size) * len(names) + pairs[at, 1])  # a document counts once for a feature
    of_doc, feature = np.divmod(held, len(names))
    toxic = np.bincount(feature[labels[of_doc] == 1], minlength=len(names))
    kept = telling(toxic, np.bincount(feature, minlength=len(names)) - toxic, int(labels.sum()), int(len(labels) - labels.sum()))
    pairs = pairs[kept[pairs[:, 1]]]
    has = np.bincount(pairs[:, 0], minlength=len(words)) > 0
    own_sentence, entry = own_sentence[has[entry]], entry[has[entry]]
    theta, bias = np.zeros(len(names)), -4.0
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    weights = weights / weights.sum()
    for step in range(1, EPOCHS + 1):
        of_word = np.bincount(pairs[:, 0], theta[pairs[:, 1]], minlength=len(words))
        z = bias + np.bincount(own_sentence, of_word[entry], minlength=len(sentence_doc))
        a = np.add.reduceat(np.logaddexp(0, z), doc_first)
        slope = np.where(labels == 1, -1 / np.expm1(np.clip(a, 1e-9, 500)), 1.0) * weights
        dz = slope[sentence_doc] / (1 + np.exp(-z))
        per_word = np.bincount(entry, dz[own_sentence], minlength=len(words))
        g = np.bincount(pairs[:, 1], per_word[pairs[:, 0]], minlength=len(names)) + DECAY * theta
        gb = dz.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        near, far = 1 - 0.9**step, 1 - 0.99**step
        theta = theta - RATE * (m / near) / (np.sqrt(v / far) + 1e-8)
        bias -= RATE * (mb / near) / (np.sqrt(vb / far) + 1e-8)
    return {f: float(theta[i]) for i, f in enumerate(names) if kept[i]}, float(bias)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of one task's rows (text, toxic, total), in order, until either label has half of SAMPLE_WORDS."""
    docs: list[list[list[str]]] = []
    labels, totals, used, same = [], {}, {0: 0, 1: 0}, {}
    for b in batches:
        for text, toxic, total in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "total"))):
            totals[toxic] = total
            if used[toxic] < SAMPLE_WORDS // 2 and (found := [[same.setdefault(w, w) for w in sorted(words)] for _, _, words in sentences(text)]):
                docs.append(found)
                labels.append(toxic)
                used[toxic] += sum(map(len, found))
    if docs:
        y = np.array(labels)
        share = {k: totals[k] / max(1, int((y == k).sum())) for k in totals}
        model, bias = learn(docs, y, np.array([share[k] for k in labels], dtype=float))
        yield pa.record_batch([pa.array([*model, None], pa.string()), pa.array([*model.values(), bias])], ["feature", "weight"])


def model(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """(weight of each feature, bias) learned from ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic) that are not held out.

    Of each label the SAMPLE documents with the least hashes are learned from, and no more words than
    SAMPLE_WORDS; a label counts as much as all its documents. A null label is none, and of several the toxic one
    counts. Without labelled texts the bias is -inf: nothing is toxic. One task learns from the bounded sample.
    """
    own = labels.where((F.col("toxic").isNotNull()) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("l_")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    own = stored(own)
    totals = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("l_")
    each = [own.where(F.col("toxic") == k).orderBy(order, "l_").limit(SAMPLE).withColumn("total", F.lit(n)) for k, n in sorted(totals.items())]
    if not each:
        return {}, float("-inf")
    sample = stored(each[0] if len(each) == 1 else each[0].unionByName(each[1]))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_"))  # 2 * SAMPLE rows at most
    rows = rows.select(order.alias("h"), "l_", "text", "toxic", "total").repartition(1).sortWithinPartitions("h", "l_", "text")
    got = stored(rows.select("text", "toxic", "total").mapInArrow(_fit, "feature string, weight double")).collect()
    return {r["feature"]: r["weight"] for r in got if r["feature"] is not None}, next((r["weight"] for r in got if r["feature"] is None), float("-inf"))


def score(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """(doc_id, score, n_sentences, offending) of ``docs`` (doc_id, text): the chance that a document is toxic, and (start, end, chance) of each sentence that offends.

    Whole texts are scored; one without words, or null, has no sentences and the score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}

        def logit(words: set[str]) -> float:
            z = bias
            for w in words:
                own = known.get(w)
                if own is None:
                    if len(known) >= _CACHE:
                        known.clear()
                    own = known[w] = sum(weights.get(f, 0.0) for f in features(w))
                z += own
            return z

        for b in batches:
            scores, counts, found = [], [], []
            for text in b.column("text").to_pylist():
                n, a, spans = 0, 0.0, []
                for start, end, words in sentences(text):
                    z = logit(words)
                    n, a = n + 1, a + (math.log1p(math.exp(z)) if z < 30 else z)
                    if z >= 0:
                        spans.append({"start": start, "end": end, "chance": 1 / (1 + math.exp(-z))})
                scores.append(-math.expm1(-a))
                counts.append(n)
                found.append(spans)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))
            yield pa.record_batch([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(found, kind)], ["doc_id", "score", "n_sentences", "offending"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_sentences int, offending array<struct<start:long,end:long,chance:double>>")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_sentences, offending), a row for each of ``docs``; offending is start:end of each sentence, comma-joined."""
    scored = score(docs, *model(docs, labels))
    spans = F.array_join(F.transform("offending", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", spans.alias("offending"))
