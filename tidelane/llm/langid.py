"""Language of documents that may mix several: expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, unwrapped, wrapped

#: Buckets that hashed byte trigrams fall into; a model has so many numbers a language.
GRAMS = 4096
#: Languages that a model may have: as many as ISO 639-3 can name, and a bound of what the driver holds.
MOST_LANGUAGES = 8192
#: Documents a batch holds while it is scored.
BATCH = 256
#: A document's steps of expectation-maximisation end when none of its proportions moves by this.
MOVE = 1e-4
_LETTER = re.compile(r"[^\W\d_]")
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[b for b in range(128) if not chr(b).isalpha()]] = 32


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed byte trigrams, a row a text: lower-cased, all but letters taken as one blank."""
    parts = [b" " + t.lower().encode() + b" " for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    data = _BLANK[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    doc = np.repeat(np.arange(len(texts), dtype=np.int64) * GRAMS, sizes)
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (doc[1:] != doc[:-1])
    data, doc = data[keep].astype(np.uint32), doc[keep]
    code = (data[:-2] * np.uint32(65599) + data[1:-1]) * np.uint32(65599) + data[2:]
    code = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    same = doc[:-2] == doc[2:]
    counts = np.bincount((code + doc[2:])[same], minlength=len(texts) * GRAMS)
    return counts.reshape(len(texts), GRAMS)


def _texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, their log-likelihoods of each gram) from all ``docs`` (text, lang) with a language.

    Tasks send their summed counts a language and gram; the result has GRAMS numbers a language, and more
    than MOST_LANGUAGES languages are an error, as the model is sent to the driver and to every task.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = _texts(batch.column("text")), batch.column("lang").to_pylist()
            for i in range(0, len(texts), BATCH):
                counts = gram_counts(texts[i : i + BATCH])
                own = np.array(langs[i : i + BATCH])
                for lang in set(own.tolist()):
                    total[lang] = total.get(lang, 0) + counts[own == lang].sum(axis=0)
        for lang, sums in total.items():
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(some), "gram": pa.array(some, pa.int32()), "n": pa.array(sums[some], pa.int64())})

    rows = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(grams, "lang string, gram int, n long")
    rows = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).limit(MOST_LANGUAGES * GRAMS + 1).collect()
    if len(rows) > MOST_LANGUAGES * GRAMS:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted({r.lang for r in rows})
    table = np.full((len(langs), GRAMS), 0.5)
    for r in rows:
        table[langs.index(r.lang), r.gram] += r.n
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def mixture(counts: np.ndarray, logp: np.ndarray, allowed: np.ndarray, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) a row, by expectation-maximisation over the ``allowed`` languages.

    A row is through when none of its proportions moves by MOVE, which comes to pass as each step raises the
    likelihood, or after ``steps`` where they are given; rows do not depend on each other.
    """
    p = np.exp(logp)
    share = (allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)).astype(np.float64)
    open_, x = np.arange(len(counts)), counts.astype(np.float64)
    for _ in count() if steps is None else range(steps):
        if not len(open_):
            break
        old = share[open_]
        new = old * ((x / np.maximum(old @ p, 1e-300)) @ p.T)
        new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-300)
        share[open_] = new
        more = np.abs(new - old).max(axis=1) >= MOVE
        if not more.all():
            open_, x = open_[more], x[more]
    return share, (counts * np.log(np.maximum(share @ p, 1e-300))).sum(axis=1)


def choose(counts: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, chosen set) a row.

    Sets are the k first languages in the order of the proportions found over all of them, or the likeliest one
    alone. The set with the largest log-likelihood less half a log(n) for each language beyond the first is
    chosen, ties to the smaller one; no other threshold has a say.
    """
    n_langs = logp.shape[0]
    n = np.maximum(counts.sum(axis=1), 1)
    single = counts.astype(np.float64) @ logp.T
    order = np.argsort(-single, axis=1, kind="stable")
    rows = np.arange(len(counts))
    share, chosen = np.zeros((len(counts), n_langs)), np.zeros((len(counts), n_langs), dtype=bool)
    share[rows, order[:, 0]], chosen[rows, order[:, 0]] = 1, True
    best = single[rows, order[:, 0]]
    if n_langs > 1:
        free, like = mixture(counts, logp, np.ones_like(share))
        rank = np.argsort(-free, axis=1, kind="stable")
        # no set does better than all languages do (1 for what the last steps leave), so larger sets can be ruled out
        open_ = np.flatnonzero(like + 1 - 0.5 * np.log(n) > best)
        for k in range(2, n_langs + 1):
            if not len(open_):
                break
            allowed = np.zeros((len(open_), n_langs))
            np.put_along_axis(allowed, rank[open_, :k], 1, axis=1)
            got, own = mixture(counts[open_], logp, allowed)
            own = own - (k - 1) * 0.5 * np.log(n[open_])
            better = own > best[open_] + 1e-9
            share[open_[better]], best[open_[better]], chosen[open_[better]] = got[better], own[better], allowed[better] > 0
            open_ = open_[like[open_] + 1 - k * 0.5 * np.log(n[open_]) > best[open_]]
    return share, chosen


PREDICTED = "lang_pred string, score double, lang_set string, proportions string"


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs`` (text) plus lang_pred, score (its proportion), lang_set and proportions.

    Text that is null or has no letter is ``und`` with score 0, and so is every text if no language was
    learned. Only the text is used. Ties go to the first language by name. Columns of ``keep`` must not be
    called like the new ones.
    """
    langs, logp = model

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, BATCH):
                batch = big.slice(i, BATCH)
                texts = _texts(batch.column(batch.num_columns - 1))
                known = [bool(langs and _LETTER.search(t)) for t in texts]
                pred, score, sets, parts = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts), [""] * len(texts)
                which = [k for k, ok in enumerate(known) if ok]
                if which:
                    share, chosen = choose(gram_counts([texts[k] for k in which]), logp)
                    top = share.argmax(axis=1)
                    for j, k in enumerate(which):
                        pred[k], score[k] = langs[top[j]], float(min(1.0, share[j, top[j]]))
                        of = sorted(np.flatnonzero(chosen[j]), key=lambda m: (-share[j, m], m))
                        sets[k] = ",".join(langs[m] for m in of)
                        parts[k] = ",".join(f"{langs[m]}={share[j, m]:.4f}" for m in of)
                arrays = [batch.column(c) for c in range(batch.num_columns - 1)]
                arrays += [pa.array(pred), pa.array(score, pa.float64()), pa.array(sets), pa.array(parts)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score", "lang_set", "proportions"])

    rows = docs.select(*keep, F.col("text").alias("text_to_predict_"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(predict, f"{kept}, {PREDICTED}")


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, lang_set, proportions): learned where crc32(doc_id) mod 4 is not 2."""
    held = crc_of_id(4) == 2
    model = learn(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"])


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows and columns of ``docs`` whose language is known and holds at least ``least`` of the text.

    Learns from all of ``docs`` that carry a language.
    """
    rows = identify(wrapped(docs, "text"), learn(docs), ["row_"])
    return unwrapped(rows.where((F.col("lang_pred") != "und") & (F.col("score") >= least)), docs)
