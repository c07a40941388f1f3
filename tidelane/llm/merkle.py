"""Merkle trees over the sections and paragraphs of documents."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_buckets

#: A leaf: 24 to 160 characters up to a blank after one of these, else 160 at most. Cuts depend on the text around them alone, so they meet again after an edit.
_LEAF = re.compile(r".{24,160}?[.,;:!?dsy][ \t]|.{1,160}", re.S)
#: A paragraph whose digest divides by this closes a section, and so does a blank line.
SECTION = 8


#: Runs of documents that a task gets on average.
RUNS = 4


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Tree:
    """root; sections, a digest each; paragraphs and leaves of each section and paragraph."""

    __slots__ = ("root", "sections", "shape", "leaves")

    def __init__(self, text: str):
        self.leaves: Counter = Counter()
        self.sections, self.shape = [], []
        own: list[bytes] = []
        lines = text.split("\n") if text else []
        for i, line in enumerate(lines):
            kids = []
            for leaf in _LEAF.findall(line):
                d = hashlib.blake2b(leaf.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                kids.append(d)
                self.leaves[d] += len(leaf)
            own.append(digest(b"p" + b"".join(kids)))
            if not line or own[-1][0] % SECTION == 0 or i == len(lines) - 1:
                self.sections.append(digest(b"s" + b"".join(own)))
                self.shape.append(own)
                own = []
        self.root = digest(b"r" + b"".join(self.sections))

    def weight(self) -> int:
        return self.leaves.total()


def likeness(a: Tree, b: Tree) -> float:
    """Share of characters in leaves that both trees hold; 1 for equal roots, so also for two empty texts."""
    if a.root == b.root:
        return 1.0
    total = a.weight() + b.weight()
    small, large = (a.leaves, b.leaves) if len(a.leaves) <= len(b.leaves) else (b.leaves, a.leaves)
    return 2.0 * sum(min(n, large[d]) for d, n in small.items() if d in large) / total if total else 0.0


def matched(a: list[bytes], b: list[bytes]) -> list[tuple[int | None, int | None]]:
    """Places of ``a`` and ``b`` side by side, in order: equal digests, else a lone or two differing ones.

    Equal ends are taken off first; each branch of ``b`` between them is matched with the next equal one of ``a``.
    """
    lo = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    hi = next((i for i, (x, y) in enumerate(zip(reversed(a[lo:]), reversed(b[lo:]))) if x != y), min(len(a), len(b)) - lo)
    at: dict[bytes, list[int]] = {}
    for i in range(lo, len(a) - hi):
        at.setdefault(a[i], []).append(i)
    pairs, i, j = [(k, k) for k in range(lo)], lo, lo

    def apart(to_i: int, to_j: int) -> None:
        n = max(to_i - i, to_j - j)
        pairs.extend((i + k if i + k < to_i else None, j + k if j + k < to_j else None) for k in range(n))

    for k in range(lo, len(b) - hi):
        places = at.get(b[k], [])
        p = bisect_left(places, i)
        if p < len(places):
            apart(places[p], k)
            pairs.append((places[p], k))
            i, j = places[p] + 1, k + 1
    apart(len(a) - hi, len(b) - hi)
    return pairs + [(len(a) - hi + k, len(b) - hi + k) for k in range(hi)]


def differences(a: Tree, b: Tree) -> list[str]:
    """All branches that differ: ``=i/p`` for a changed paragraph p of section i of ``a``, ``-i/p`` for one that ``b`` lacks, ``+j/q`` for one that only ``b`` has.

    Only branches with differing digests are entered.
    """
    out: list[str] = []
    if a.root == b.root:
        return out
    runs: list[tuple[list[int], list[int]]] = [([], [])]  # sections between equal ones: an edit may join or cut sections
    for i, j in matched(a.sections, b.sections):
        if i is not None and j is not None and a.sections[i] == b.sections[j]:
            runs.append(([], []))
            continue
        runs[-1][0].extend([] if i is None else [i])
        runs[-1][1].extend([] if j is None else [j])
    for own, other in runs:
        x, y = ([(k, p) for k in sections for p in range(len(tree.shape[k]))] for tree, sections in ((a, own), (b, other)))
        for p, q in matched([a.shape[k][n] for k, n in x], [b.shape[k][n] for k, n in y]):
            if p is None:
                out.append("+{}/{}".format(*y[q]))
            elif q is None:
                out.append("-{}/{}".format(*x[p]))
            elif a.shape[x[p][0]][x[p][1]] != b.shape[y[q][0]][y[q][1]]:
                out.append("={}/{}".format(*x[p]))
    return out


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by the first as many characters of ``after``."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


SCHEMA = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_sections int, n_paragraphs int, n_leaves int, edits string"
)


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, is_next, doc_id, text): runs of ``docs`` by ascending doc_id, each followed by the first row of the next run.

    Bounds are quantiles of the ids alone; the first row of each run, a table as long as there are runs, is
    sent to the run before as well (that of the first run to the last), so each row finds its follower in its
    own run and texts move once. Null ids stand first; equal ids stand together, by text.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    n = RUNS * n_buckets(spark)  # more runs than tasks, so that tasks get about as many each
    cuts = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10_000).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: c <= key)) if cuts else F.lit(0)
    heads = sorted((r.b, r.k) for r in docs.select(bucket.alias("b"), key.alias("k")).groupBy("b").agg(F.min("k").alias("k")).collect())
    to = spark.createDataFrame([(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)], "head_ long, to_ int")
    rows = docs.select("doc_id", "text", key.alias("k"), bucket.alias("bucket"))
    rows = rows.join(F.broadcast(to), rows.k == F.col("head_"), "left")
    both = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("is_next")), F.struct(F.col("to_").alias("bucket"), F.lit(True).alias("is_next")))
    one = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("is_next")))
    rows = rows.select("doc_id", "text", "k", F.explode(F.when(F.col("to_").isNotNull(), both).otherwise(one)).alias("at"))
    return rows.select("at.bucket", "at.is_next", "k", "doc_id", "text").repartition(n_buckets(spark), "bucket").sortWithinPartitions("bucket", "is_next", "k", "text").drop("k")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, ...) of whole ``docs``.

    A fingerprint is the root over sections over paragraphs over leaves, in hexadecimal, so equal texts have
    equal ones. The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document by doc_id; the last is followed by the first, a lone one by itself. edits
    names all sections and paragraphs whose branches differ (``differences``). Null text is empty; likeness is the share of
    characters in common leaves, 1 if both are empty. Rows with equal ids follow each other by text.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, tree): waits for its follower
        done = None  # the bucket whose last row is out
        for batch in batches:
            out = []
            for bucket, is_next, doc, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if bucket == done:
                    continue  # more rows with the follower's id
                text = text or ""
                tree = Tree(text)
                if held is not None:
                    _, own_id, own_text, own = held
                    new = edited(own_text, text)
                    other = Tree(new)
                    out.append(
                        (
                            own_id,
                            len(own_text),
                            hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                            own.root.hex(),
                            other.root.hex(),
                            likeness(own, other),
                            likeness(own, tree),
                            len(own.sections),
                            sum(map(len, own.shape)),
                            len(own.leaves),
                            ",".join(differences(own, other)),
                        )
                    )
                held, done = (None, bucket) if is_next else ((bucket, doc, text, tree), None)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]]
    by = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    types = [by[kind], *[by[x.split()[1]] for x in SCHEMA.split(", ")]]
    return in_order(docs).mapInArrow(follow, f"doc_id {kind}, {SCHEMA}")
