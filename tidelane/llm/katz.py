"""Katz backoff language model: Good-Turing discounted bigrams over Good-Turing unigrams, exactly normalised.

Words are cut once into *chunks*: runs of whole documents with a million words or so. A chunk asks for what it
needs by blobs, packed arrays of its distinct words and word pairs, a blob for each bucket of the model's
tables; the tables' buckets add the chunks' counts up and answer, a blob for each chunk. So each count moves
once a chunk and not once a token, and no table is ever whole in one place.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, n_buckets, stored, stored_by
from .words import word_codes

#: Words after which a chunk ends, at the end of a document.
CHUNK_WORDS = 1_000_000
#: Chunks for each bucket of the word and pair tables, so that a bucket's size does not grow with the corpus.
CHUNKS = 4
#: Texts whose words are coded at once.
TEXTS = 256
#: Counts up to this are discounted.
K = 5
#: The end of a document is a token of its own; no word has this code.
END = np.uint64(0)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the texts' tokens, number of tokens of each): the words' codes, then the end, text by text."""
    codes, counts = word_codes(texts)
    return np.insert(np.where(codes == END, _MIX, codes), np.cumsum(counts), END), counts + 1


def packed(a: np.ndarray) -> bytes:
    """Compressed, lowest bytes first: high ones of small numbers are runs of zeros."""
    return zlib.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(a.size, a.itemsize).T).tobytes(), 1)


def unpacked(b: bytes, dtype: type) -> np.ndarray:
    raw, size = np.frombuffer(zlib.decompress(b), dtype=np.uint8), np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(dtype)


def packed_keys(keys: np.ndarray) -> bytes:
    """Rising keys of two 32-bit halves: the steps of the upper ones, then the lower ones."""
    upper = (keys >> np.uint64(32)).astype(np.uint32)
    return packed(np.concatenate([np.diff(upper, prepend=np.uint32(0)), keys.astype(np.uint32)]))


def unpacked_keys(b: bytes) -> np.ndarray:
    both = unpacked(b, np.uint32)
    n = len(both) // 2
    return np.cumsum(both[:n], dtype=np.uint32).astype(np.uint64) << np.uint64(32) | both[n:]


def discounts(n_of_n: dict[int, int]) -> np.ndarray:
    """Katz's factors d[c] for counts c up to K (d[0] unused), from how many types have each count.

    Where Good-Turing gives none in (0, 1), as on tiny or odd data, the factor is (c - 1/2) / c.
    """
    n = [n_of_n.get(c, 0) for c in range(K + 2)]
    out = np.ones(K + 1)
    cut = (K + 1) * n[K + 1] / n[1] if n[1] else None
    for c in range(1, K + 1):
        d = None
        if cut is not None and cut < 1 and n[c]:
            d = ((c + 1) * n[c + 1] / n[c] / c - cut) / (1 - cut)
        out[c] = d if d is not None and 0 < d < 1 else (c - 0.5) / c
    return out


class Unigrams:
    """log10 probability of a word by its count; unknown words share what discounting leaves, as one event."""

    def __init__(self, total: int, n_of_n: dict[int, int], types: int):
        self.total, self.types = total, types
        d = discounts(n_of_n)
        kept = sum(d[c] * c * n_of_n.get(c, 0) for c in range(1, K + 1)) + (total - sum(c * n_of_n.get(c, 0) for c in range(1, K + 1)))
        left = 1 - kept / total if total else 1.0
        #: Without a count up to K nothing is left: then every count gives way for one more.
        self.scale = 1.0 if left > 1e-9 or not total else total / (total + 1)
        self.unknown = left if left > 1e-9 or not total else 1 / (total + 1)
        self.d = d

    def p(self, count: np.ndarray) -> np.ndarray:
        c = count.astype(np.float64)
        return np.where(count > 0, self.scale * self.d[np.minimum(count, K) * (count <= K)] ** (count <= K) * c / max(self.total, 1), self.unknown)


def history(stats: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, scale, alpha) of each history from its sums: n_1 .. n_K, words under larger counts, unigram mass seen.

    alpha is what the seen pairs leave, over the unigram mass of the unseen ones, so that all sums to 1. If
    they leave nothing, each seen probability gives way for one more count; if no word is unseen, the pairs
    are scaled up to 1.
    """
    small = stats[:, :K] * np.arange(1, K + 1)
    count = small.sum(axis=1) + stats[:, K]
    safe = np.maximum(count, 1)
    kept = ((small * d[1:]).sum(axis=1) + stats[:, K]) / safe
    scale = np.where(kept < 1 - 1e-12, 1.0, count / (count + 1.0))
    unseen = 1 - stats[:, K + 1]
    full = unseen <= 1e-12
    scale = np.where(full, 1 / np.maximum(kept, 1e-300), scale)
    alpha = np.where(full, 0.0, (1 - kept * scale) / np.where(full, 1.0, unseen))
    return count, scale, np.where(count > 0, alpha, 1.0)


def _chunks(docs: DataFrame, chunk_words: int) -> DataFrame:
    """(chunk, docs, words): a row a chunk; docs and words are packed arrays."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, codes, each, n = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            tokens = np.concatenate(codes)
            words, index = np.unique(tokens, return_inverse=True)
            sizes = np.concatenate(each).astype(np.int64)
            train = np.repeat(~np.array(held, dtype=bool), sizes)
            counts = np.bincount(index[train], minlength=len(words))
            return pa.RecordBatch.from_pydict(
                {
                    "chunk": [uuid.uuid4().hex],
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "held": pa.array([held], pa.list_(pa.bool_())),
                    "sizes": pa.array([packed(sizes)], pa.binary()),
                    "tokens": pa.array([packed(index.astype(np.int32))], pa.binary()),
                    "words": pa.array([words.tobytes()], pa.binary()),
                    "counts": pa.array([packed(counts.astype(np.int64))], pa.binary()),
                }
            )

        for big in batches:
            for i in range(0, big.num_rows, TEXTS):
                batch = big.slice(i, TEXTS)
                tokens, sizes = encode(batch.column("text").to_pylist())
                ids += batch.column("doc_id").to_pylist()
                held += batch.column("held_out").to_pylist()
                codes.append(tokens)
                each.append(sizes)
                n += len(tokens)
                if n >= chunk_words:
                    yield out()
                    ids, held, codes, each, n = [], [], [], [], 0
        if ids:
            yield out()

    schema = "chunk string, ids array<long>, held array<boolean>, sizes binary, tokens binary, words binary, counts binary"
    return docs.select("doc_id", "held_out", "text").mapInArrow(cut, schema)


def _bucket_runs(bucket: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(stable order by bucket, [(bucket, from, to)])."""
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n))
    starts = np.concatenate([[0], ends[:-1]])
    return order, [(b, int(s), int(e)) for b, (s, e) in enumerate(zip(starts, ends, strict=True)) if e > s]


def _sum_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their sums, index of each key)."""
    unique, index = np.unique(keys, return_inverse=True)
    return unique, np.bincount(index, weights=values, minlength=len(unique)).astype(np.int64), index


def _word_questions(n: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "counts")), strict=True):
                w, c = np.frombuffer(words, dtype=np.uint64), unpacked(counts, np.int64)
                order, runs = _bucket_runs((w % np.uint64(n)).astype(np.int64), n)
                w, c = w[order], c[order]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([b for b, _, _ in runs], pa.int32()),
                        "chunk": [chunk] * len(runs),
                        "words": pa.array([w[s:e].tobytes() for _, s, e in runs], pa.binary()),
                        "counts": pa.array([packed(c[s:e]) for _, s, e in runs], pa.binary()),
                    }
                )

    return ask


ANSWER = "bucket int, chunk string, answer binary, more binary, total long, types long, n_of_n array<long>"


def _answer_words(n: int):
    def answer(key: tuple, table: pa.Table) -> pa.Table:
        """Each word's id, unique over all buckets, and its count in training."""
        bucket = key[0].as_py()
        chunks = table["chunk"].to_pylist()
        words = [np.frombuffer(b, dtype=np.uint64) for b in table["words"].to_pylist()]
        counts = np.concatenate([unpacked(b, np.int64) for b in table["counts"].to_pylist()])
        unique, sums, index = _sum_by_key(np.concatenate(words), counts)
        if len(unique) * n >= 1 << 32:
            raise ValueError("more than 2**32 distinct words")
        ids = (index * n + bucket).astype(np.uint32)
        ends = np.cumsum([len(w) for w in words])
        parts = list(zip([0, *ends[:-1]], ends, strict=True))
        some = [int((sums == c).sum()) for c in range(1, K + 2)]
        blank = [None] * (len(chunks) - 1)
        return pa.table(
            {
                "bucket": pa.array([bucket] * len(chunks), pa.int32()),
                "chunk": pa.array(chunks, pa.string()),
                "answer": pa.array([packed(ids[s:e]) for s, e in parts], pa.binary()),
                "more": pa.array([packed(sums[index[s:e]]) for s, e in parts], pa.binary()),
                "total": pa.array([int(sums.sum()), *blank], pa.int64()),
                "types": pa.array([int((sums > 0).sum()), *blank], pa.int64()),
                "n_of_n": pa.array([some, *blank], pa.list_(pa.int64())),
            }
        )

    return answer


def _totals(answers: DataFrame) -> tuple[int, int, dict[int, int]]:
    sums = [F.sum("total"), F.sum("types"), *[F.sum(F.col("n_of_n")[c]) for c in range(K + 1)]]
    row = answers.where("total is not null").agg(*sums).first()
    return int(row[0] or 0), int(row[1] or 0), {c + 1: int(row[2 + c] or 0) for c in range(K + 1)}


def _known(words: np.ndarray, answers: list[tuple[int, bytes, bytes]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, count) of each of a chunk's words from the answers (bucket, ids, counts)."""
    ids, counts = np.zeros(len(words), dtype=np.uint32), np.zeros(len(words), dtype=np.int64)
    order, runs = _bucket_runs((words % np.uint64(n)).astype(np.int64), n)
    at = {b: (s, e) for b, s, e in runs}
    for b, blob, more in answers:
        s, e = at[b]
        ids[order[s:e]] = unpacked(blob, np.uint32)
        counts[order[s:e]] = unpacked(more, np.int64)
    return ids, counts


def _spread(count: np.ndarray, total: int, n: int) -> np.ndarray:
    """Over how many buckets the pairs of a history are dealt: one, more where it holds over 1 / 4n of all tokens."""
    return np.minimum(n, 1 + count * 4 * n // max(total, 1)).astype(np.int64)


class _Pairs:
    """A chunk's distinct pairs and histories, in the order of their blobs; the same whenever it is built."""

    def __init__(self, row: dict, ids: np.ndarray, counts: np.ndarray, total: int, n: int):
        self.sizes, index = unpacked(row["sizes"], np.int64), unpacked(row["tokens"], np.int32)
        self.ids, self.counts, self.index = ids, counts, index
        first = np.zeros(len(index), dtype=bool)
        first[np.cumsum(self.sizes)[:-1]] = True
        if len(first):
            first[0] = True
        end = int(np.searchsorted(np.frombuffer(row["words"], dtype=np.uint64), END)) if len(index) else 0
        past = np.empty_like(index)
        past[1:], past[first] = index[:-1], end  # a document begins after an end
        self.past = past
        key = past.astype(np.int64) << 32 | index
        self.pairs, self.of = np.unique(key, return_inverse=True)
        train = np.repeat(~np.array(row["held"], dtype=bool), self.sizes)
        self.n = np.bincount(self.of[train], minlength=len(self.pairs))
        h, w = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        spread = _spread(counts, total, n)
        own = (ids[h].astype(np.uint64) * _MIX >> np.uint64(33)).astype(np.int64)
        turn = (ids[w].astype(np.uint64) * _MIX >> np.uint64(35)).astype(np.int64) % spread[h]
        bucket = (own + turn) % n
        rising = np.lexsort((ids[w], ids[h]))
        order, self.runs = _bucket_runs(bucket[rising], n)
        self.order = rising[order]  # by bucket, then rising by the words' ids
        self.h, self.w = h, w
        # Histories: each asks all buckets that its pairs, those of other chunks too, are dealt over.
        hs = np.unique(h)
        copies = spread[hs]
        rep = np.repeat(hs, copies)
        step = np.arange(len(rep)) - np.repeat(np.cumsum(copies) - copies, copies)
        place = ((ids[rep].astype(np.uint64) * _MIX >> np.uint64(33)).astype(np.int64) + step) % n
        self.h_order, self.h_runs = _bucket_runs(place, n)
        self.rep = rep


def _pair_questions(n: int, total: int):
    def ask(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        got = list(zip(*(answers[c].to_pylist() for c in ("bucket", "answer", "more")), strict=True))
        ids, counts = _known(np.frombuffer(row["words"], dtype=np.uint64), got, n)
        p = _Pairs(row, ids, counts, total, n)
        keys = (ids[p.h].astype(np.uint64) << np.uint64(32) | ids[p.w])[p.order]
        seen, second = p.n[p.order], counts[p.w][p.order]
        asked = ids[p.rep][p.h_order]
        pairs, hist = {b: (s, e) for b, s, e in p.runs}, {b: (s, e) for b, s, e in p.h_runs}
        buckets = sorted({*pairs, *hist})
        cut = lambda a, of, b: a[slice(*of.get(b, (0, 0)))]
        return pa.table(
            {
                "bucket": pa.array(buckets, pa.int32()),
                "chunk": pa.array([row["chunk"]] * len(buckets), pa.string()),
                "keys": pa.array([packed_keys(cut(keys, pairs, b)) for b in buckets], pa.binary()),
                "counts": pa.array([packed(cut(seen, pairs, b)) for b in buckets], pa.binary()),
                "second": pa.array([packed(cut(second, pairs, b)) for b in buckets], pa.binary()),
                "histories": pa.array([packed(cut(asked, hist, b)) for b in buckets], pa.binary()),
            }
        )

    return ask


def _answer_pairs(unigrams: Unigrams):
    def answer(key: tuple, table: pa.Table) -> pa.Table:
        """Each pair's count in training, and each history's sums over this bucket's pairs."""
        chunks = table["chunk"].to_pylist()
        keys = [unpacked_keys(b) for b in table["keys"].to_pylist()]
        counts = np.concatenate([unpacked(b, np.int64) for b in table["counts"].to_pylist()])
        second = np.concatenate([unpacked(b, np.int64) for b in table["second"].to_pylist()])
        asked = [unpacked(b, np.uint32) for b in table["histories"].to_pylist()]
        unique, at, index = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        sums = np.bincount(index, weights=counts, minlength=len(unique)).astype(np.int64)
        some = sums > 0
        hs, own = np.unique((unique[some] >> np.uint64(32)).astype(np.uint32), return_inverse=True)
        c = sums[some]
        stats = np.zeros((len(hs) + 1, K + 2))
        for k in range(1, K + 1):
            stats[:-1, k - 1] = np.bincount(own[c == k], minlength=len(hs))
        stats[:-1, K] = np.bincount(own[c > K], weights=c[c > K], minlength=len(hs))
        stats[:-1, K + 1] = np.bincount(own, weights=unigrams.p(second[at[some]]), minlength=len(hs))
        flat = np.concatenate(asked)
        place = np.searchsorted(hs, flat)
        place[place < len(hs)] = np.where(hs[place[place < len(hs)]] == flat[place < len(hs)], place[place < len(hs)], len(hs))
        ends, h_ends = np.cumsum([len(k) for k in keys]), np.cumsum([len(a) for a in asked])
        blank = [None] * (len(chunks) - 1)
        return pa.table(
            {
                "bucket": pa.array([key[0].as_py()] * len(chunks), pa.int32()),
                "chunk": pa.array(chunks, pa.string()),
                "answer": pa.array([packed(sums[index[s:e]]) for s, e in zip([0, *ends[:-1]], ends, strict=True)], pa.binary()),
                "more": pa.array([packed(np.ascontiguousarray(stats[place[s:e]].T)) for s, e in zip([0, *h_ends[:-1]], h_ends, strict=True)], pa.binary()),
                "total": pa.array([int(sums.sum()), *blank], pa.int64()),
                "types": pa.array([int(some.sum()), *blank], pa.int64()),
                "n_of_n": pa.array([[int((sums == c).sum()) for c in range(1, K + 2)], *blank], pa.list_(pa.int64())),
            }
        )

    return answer


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_backed_off long"


def _scores(n: int, total: int, unigrams: Unigrams, d: np.ndarray):
    def score(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        kind, bucket, answer, more = (answers[c].to_pylist() for c in ("kind", "bucket", "answer", "more"))
        got = [(b, a, m) for k, b, a, m in zip(kind, bucket, answer, more, strict=True) if k == 0]
        ids, counts = _known(np.frombuffer(row["words"], dtype=np.uint64), got, n)
        p = _Pairs(row, ids, counts, total, n)
        pairs, hist = {b: (s, e) for b, s, e in p.runs}, {b: (s, e) for b, s, e in p.h_runs}
        c12 = np.zeros(len(p.pairs), dtype=np.int64)
        stats = np.zeros((len(counts), K + 2))
        for k, b, a, m in zip(kind, bucket, answer, more, strict=True):
            if k == 1:
                if b in pairs:
                    c12[p.order[slice(*pairs[b])]] = unpacked(a, np.int64)
                if b in hist:
                    who = p.rep[p.h_order[slice(*hist[b])]]  # a history comes once a bucket
                    stats[who] += unpacked(m, np.float64).reshape(K + 2, -1).T
        count, scale, alpha = history(stats, d)
        single = unigrams.p(counts)
        low = np.minimum(c12, K) * (c12 <= K)
        seen = scale[p.h] * d[low] ** (c12 <= K) * c12 / np.maximum(count[p.h], 1)
        with np.errstate(divide="ignore"):
            pair = np.log10(np.where(c12 > 0, seen, alpha[p.h] * single[p.w]))
        base = np.log10((counts + 1) / (unigrams.total + unigrams.types + 1))
        starts = np.cumsum(p.sizes) - p.sizes
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every document has a token
        return pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "held_out": pa.array(row["held"], pa.bool_()),
                "n_tokens": pa.array(p.sizes, pa.int64()),
                "n_known": pa.array(add((counts > 0)[p.index].astype(np.int64)), pa.int64()),
                "train_tokens": pa.array([unigrams.total] * len(p.sizes), pa.int64()),
                "base_score": pa.array(add(base[p.index]), pa.float64()),
                "score": pa.array(add(pair[p.of]), pa.float64()),
                "n_backed_off": pa.array(add((c12 == 0)[p.of].astype(np.int64)), pa.int64()),
            }
        )

    return score


def scored(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Scores of all whole ``docs`` (doc_id, held_out, text) under a model of those that are not held out.

    A token is scored by log10 P(w | the token before), a document beginning after an end; seen pairs have
    their discounted share, others alpha(history) P(w), and P(w) of a word unknown to training is the mass
    that discounting leaves to unknown words. Null text is empty: the end alone. held_out must not be null.
    base_score is the add-one unigram score. n_backed_off counts tokens whose pair training does not hold.
    Rows are scored as they come, repeated ones too; with no training text every word is unknown.

    Stored in the shared folder: chunks of encoded documents, and the answers of the word and pair tables by
    bucket. Only the sums of counts of counts come to the driver.
    """
    spark = docs.sparkSession
    chunks = stored_by(_chunks(docs, chunk_words), "chunk", n_buckets(spark))
    n = max(n_buckets(spark), -(-chunks.count() // CHUNKS))
    words = stored(chunks.mapInArrow(_word_questions(n), "bucket int, chunk string, words binary, counts binary").groupBy("bucket").applyInArrow(_answer_words(n), ANSWER))
    total, types, n_of_n = _totals(words)
    unigrams = Unigrams(total, n_of_n, types)
    keyed = chunks.groupBy("chunk")
    asked = keyed.cogroup(words.groupBy("chunk")).applyInArrow(_pair_questions(n, total), "bucket int, chunk string, keys binary, counts binary, second binary, histories binary")
    pairs = stored(asked.groupBy("bucket").applyInArrow(_answer_pairs(unigrams), ANSWER))
    d = discounts(_totals(pairs)[2])
    answers = words.select(F.lit(0).alias("kind"), "bucket", "chunk", "answer", "more").unionByName(pairs.select(F.lit(1).alias("kind"), "bucket", "chunk", "answer", "more"))
    return keyed.cogroup(answers.groupBy("chunk")).applyInArrow(_scores(n, total, unigrams, d), SCHEMA)


def score_documents(docs: DataFrame) -> DataFrame:
    """``scored`` with the documents whose crc32(doc_id as text) mod 7 is 2 held out."""
    return scored(docs.select("doc_id", (crc_of_id(7) == 2).alias("held_out"), "text"))
