"""Near-duplicate documents: SetSketch registers, banded, estimated jointly by likelihood, verified on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, unwrapped, wrapped
from .components import likely_in, linked_components, merged, with_least
from .words import mixed, word_codes

#: Registers of a sketch, their base, and the rate of the exponentials.
M, BASE, RATE = 256, 1.001, 20.0
#: Registers in a band; at a similarity of 0.85 a pair shares no band with a probability below 1e-8.
BAND = 6
#: Sets and shingles of a block of a family on average, and shingles that blocks are compared by at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 128, 1 << 18, 4096
#: How far below the threshold an estimate may lie before a pair is dropped unverified, in standard errors.
SIGMAS = 5.0
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles of ``words`` words; fewer words are one shingle, none give none."""
    codes, counts = word_codes(texts)
    rolled = np.full(len(codes), np.uint64(words), dtype=np.uint64)
    for i in range(words):
        ahead = np.zeros(len(codes), dtype=np.uint64)
        ahead[: max(0, len(codes) - i)] = codes[i:]
        rolled = rolled * _P1 + ahead
    rolled = mixed(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            own = np.sort(rolled[at : at + n - words + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[:1] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        else:
            whole = np.uint64(n)
            for c in codes[at : at + n]:
                whole = mixed(np.array([whole]) * _P1 + c)[0]
            out.append(np.array([whole] if n else [], dtype=np.uint64))
        at += n
    return out


def shingles(text: str | None, words: int) -> np.ndarray:
    return shingle_sets([text], words)[0]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, a row a set, of whole non-empty sets; equal to the maximum over the sketches of any parts.

    Each element spreads M values, one in each of M consecutive intervals in which an exponential of rate RATE
    falls with equal probability, over the registers in an order of its own. A register keeps the least value,
    as floor(1 - log_BASE(value)). Values rise from interval to interval, so a set is through once its largest
    register lies below the next interval.
    """
    d = len(sets)
    best = np.full(d * M, np.inf)
    flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    doc = np.repeat(np.arange(d), [len(s) for s in sets])
    start, step = (mixed(flat ^ _P2) & np.uint64(M - 1)).astype(np.int64), (mixed(flat ^ _P3) & np.uint64(M - 1)).astype(np.int64) | 1
    edge = -np.log1p(-np.arange(M) / M) / RATE  # where interval j begins
    for j in range(M):
        u = (mixed(flat + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) / 2**53
        # an exponential, given that it falls into interval j: its quantile lies in [j/M, (j+1)/M)
        x = -np.log1p(-(j + u) / M) / RATE
        np.minimum.at(best, doc * M + (start + j * step) % M, x)
        if j + 1 == M:
            break
        worst = best.reshape(d, M).max(axis=1)
        more = (worst > edge[j + 1])[doc]
        if not more.all():
            flat, doc, start, step = flat[more], doc[more], start[more], step[more]
        if not len(flat):
            break
    k = np.floor(1 - np.log(best) / np.log(BASE))
    return np.clip(k + 20_000, 0, 65_535).astype(np.uint16).reshape(d, M)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    n = M // BAND
    r = registers[:, : n * BAND].astype(np.uint64).reshape(-1, n, BAND)
    out = np.broadcast_to(np.arange(n, dtype=np.uint64) + _P3, (len(r), n)).copy()
    for i in range(BAND):
        out = mixed(out * _P1 + r[:, :, i] + _P2)
    return out


def joint_estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from the counts of registers above, below and equal, with sizes known.

    With u = nx / (nx + ny) and v = ny / (nx + ny), a register of x lies above y's with p(u - v J), below with
    p(v - u J) and is equal otherwise, where p(t) = -log_b(1 - t (b - 1) / b); J up to min(u / v, v / u) has
    the largest likelihood, found by golden section, all pairs at once.
    """
    above, below = (x > y).sum(axis=1), (x < y).sum(axis=1)
    same = M - above - below
    u = nx / (nx + ny)
    v = 1 - u

    def p(t: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(t, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    def like(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return above * np.log(a) + below * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, e = hi - g * (hi - lo), lo + g * (hi - lo)
        left = like(c) >= like(e)
        lo, hi = np.where(left, lo, c), np.where(left, e, hi)
    return (lo + hi) / 2


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, registers): set_key is equal for equal sets; without shingles the last two are null."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 128):
                batch = big.slice(i, 128)
                sets = shingle_sets(batch.column("text").to_pylist(), words)
                some = [s for s in sets if len(s)]
                rows = iter(sketches(some))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "set_key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        "registers": pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, registers binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(key, id, load): a row for each band of each of ``reps`` (id, n_shingles, registers); load is the number of shingles."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.stack([np.frombuffer(r, dtype=np.uint16) for r in batch.column("registers").to_pylist()]))
                ids, loads = (np.repeat(batch.column(c).to_numpy(), keys.shape[1]) for c in ("id", "n_shingles"))
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel().view(np.int64)), "id": pa.array(ids), "load": pa.array(loads)})

    return reps.select("id", "n_shingles", "registers").mapInArrow(band, "key long, id long, load long")


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose joint estimate is not clearly below the threshold."""
    least = percent / 100 - SIGMAS * float(np.sqrt(percent / 100 * (1 - percent / 100) / M))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.stack([np.frombuffer(r, dtype=np.uint16) for r in batch.column(c).to_pylist()]) for c in ("ra", "rb"))
                na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
                ok = joint_estimate(x, y, na, nb) >= least
                yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(ok)) for c in ("a", "b")})

    return pairs.mapInArrow(keep, "a long, b long")


def links_between(x: list[np.ndarray], y: list[np.ndarray], cx: np.ndarray, cy: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Positions (i, j) of linked sets of ``x`` and ``y``, enough to join all components (cx, cy) that are linked here.

    Intersections are counted exactly, by products of 0/1 matrices over the shingles that several sets hold.
    """
    sizes = np.array([len(s) for s in [*x, *y]])
    flat, owner = np.concatenate([*x, *y]), np.repeat(np.arange(len(sizes)), sizes)
    unique, index, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    keep = times[index] > 1
    index, owner = column[index[keep]], owner[keep]
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    both = np.zeros((len(x), len(y)), dtype=np.float64)
    for start in range(0, int(index[-1]) + 1 if len(index) else 0, COLUMNS):
        lo, hi = np.searchsorted(index, [start, start + COLUMNS])
        has = np.zeros((len(sizes), COLUMNS), dtype=np.float32)
        has[owner[lo:hi], index[lo:hi] - start] = 1
        both += has[: len(x)] @ has[len(x) :].T
    total = sizes[: len(x), None] + sizes[None, len(x) :] - both
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    out = []
    for i, j in zip(*np.nonzero((100 * both >= percent * total) & (cx[:, None] != cy[None, :])), strict=True):
        a, b = root(int(cx[i])), root(int(cy[j]))
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def linked(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_in_class) of whole ``docs`` (doc_id, text).

    Two documents are linked if 100 * |A and B| >= percent * |A or B| over their sets of distinct word
    shingles; words are cut at ASCII blanks, A-Z lower-cased. component_id is the smallest doc_id reachable.
    Documents with equal sets are one class, and only one set a class is sketched, banded and compared, so
    copies cost no pairs. Candidates share a band of registers; pairs whose
    estimate is far below the threshold go, all others are verified on their full sets (of 64-bit hashes of the
    shingles); see ``linked_components`` for which pairs are asked for. Null and blank texts
    have no shingles and are linked with nothing. Rows with a null doc_id are left out of comparison and keep
    a null component_id. Rows that repeat an id share its component, also if their texts differ: then the id
    links the classes of all its texts.
    """
    signed = stored(_signatures(docs, words))
    own = signed.where("set_key is not null and doc_id is not null")
    classes = own.groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_in_class"), F.first("n_shingles").alias("n_shingles"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()))
    named = classes.select(F.col("set_key").alias("k"), "id", "first_id")
    reps = own.join(named, (own.set_key == named.k) & (own.doc_id == named.first_id)).select("id", "n_shingles", "registers")
    reps = stored(reps.dropDuplicates(["id"]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sets_of(ids: DataFrame) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for i in range(0, big.num_rows, 128):
                    batch = big.slice(i, 128)
                    sets = shingle_sets(batch.column("text").to_pylist(), words)
                    same = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k for s, k in zip(sets, batch.column("k").to_pylist(), strict=True)], pa.bool_())
                    yield pa.RecordBatch.from_pydict({"id": batch.column("id").filter(same), "set": pa.array([s.tobytes() for s in sets], pa.binary()).filter(same)})

        asked = stored(named.join(ids.select(F.col("id").alias("i")), F.col("id") == F.col("i")).select("id", "k", "first_id"))
        found = likely_in(texts, "doc_id", asked.select(F.col("first_id").alias("k"))).join(asked, F.col("doc_id") == F.col("first_id"))
        found = stored(found.select("id", "k", "text").mapInArrow(pack, "id long, set binary"))
        return found.dropDuplicates(["id"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")})

    def prepare(ids: DataFrame):
        sets = sets_of(ids)
        left = reps.select(F.col("id").alias("ia"), F.col("registers").alias("ra"), F.col("n_shingles").alias("na"))
        right = reps.select(F.col("id").alias("ib"), F.col("registers").alias("rb"), F.col("n_shingles").alias("nb"))
        x, y = sets.select(F.col("id").alias("xa"), F.col("set").alias("sa")), sets.select(F.col("id").alias("yb"), F.col("set").alias("sb"))

        def verify(pairs: DataFrame) -> DataFrame:
            joined = pairs.select("a", "b").join(left, F.col("a") == F.col("ia")).join(right, F.col("b") == F.col("ib"))
            likely = _likely(joined.select("a", "b", "ra", "rb", "na", "nb"), percent)
            return likely.join(x, likely.a == x.xa).join(y, likely.b == y.yb).select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")

        def compare(key: tuple, table: pa.Table) -> pa.Table:
            block, ids, comp = (table[c].to_numpy() for c in ("block", "id", "component"))
            held = [np.frombuffer(b, dtype=np.uint64) for b in table["set"].to_pylist()]
            one, other = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
            found = links_between([held[k] for k in one], [held[k] for k in other], comp[one], comp[other], percent) if len(one) and len(other) else []
            a, b = [ids[one[i]] for i, _ in found], [ids[other[j]] for _, j in found]
            return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

        def settle(rest: DataFrame) -> DataFrame:
            """Families are cut into blocks; each two blocks of a family meet in a task, with their full sets."""
            sized = rest.join(classes.select(F.col("id").alias("sid"), "n_shingles"), F.col("id") == F.col("sid"))
            n = stored(sized.groupBy(F.col("family").alias("f")).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks")))
            d = rest.join(n, F.col("family") == F.col("f")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
            d = d.select("family", "id", "component", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("with"))
            d = d.join(x, F.col("id") == F.col("xa")).select("family", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "id", "component", "block", F.col("sa").alias("set"))
            return d.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long")

        return verify, settle

    def near(na, nb):
        """Sizes alone can rule a pair out: the intersection is at most the smaller set."""
        return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent

    found = linked_components(_bands(reps), near, prepare)
    of_id = own.join(classes.select(F.col("set_key").alias("k"), "id", "n_in_class"), own.set_key == F.col("k")).select("doc_id", "id", "n_in_class")
    of_id = stored(of_id)
    # an id with several texts links their classes
    several = stored(of_id.groupBy(F.col("doc_id").alias("d")).agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("d", "a"))
    if not several.isEmpty():
        found = stored(merged(found, stored(of_id.join(several, F.col("doc_id") == F.col("d")).where("a < id").select("a", F.col("id").alias("b")).distinct())))
    in_class = classes.join(found.select(F.col("id").alias("cid"), "component"), classes.id == F.col("cid"), "left").select(F.col("id").alias("c"), "first_id", F.coalesce("component", "id").alias("component"))
    in_class = stored(in_class)
    least = with_least(in_class.select("component", "first_id", "c"), "component", "first_id").select("c", "m")
    by_id = of_id.join(stored(least), F.col("id") == F.col("c")).groupBy(F.col("doc_id").alias("d")).agg(F.min("m").alias("m"), F.max("n_in_class").alias("n_in_class"))
    out = signed.join(by_id, signed.doc_id == F.col("d"), "left")
    component = F.coalesce("m", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), F.coalesce("n_in_class", F.lit(1)).alias("n_in_class"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows and columns of ``docs`` that are kept: the smallest doc_id of each component.

    Rows that repeat a kept id all stay, and so do rows with a null doc_id.
    """
    gone = linked(docs, words, percent).where("not kept").select(F.col("doc_id").alias("gone_")).distinct()
    return unwrapped(wrapped(docs, "doc_id").join(gone, F.col("doc_id") == F.col("gone_"), "left_anti"), docs)


def sql(words: int = 3, percent: int = 85) -> str:
    """The rows of ``linked`` in DuckDB's SQL, by inverted lists of each set's rarest shingles; null ids are linked with nothing.

    Two sets that share enough share one of their n - ceil(percent n / 100) + 1 rarest shingles each.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""with recursive worded as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as materialized (select doc_id, case when len(w) = 0 then [] when len(w) < {words} then [array_to_string(w, ' ')] else list_sort(list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: {shingle}))) end as s from worded),
keyed as materialized (select doc_id, len(s) as n, s, case when doc_id is not null and len(s) > 0 then sha256(array_to_string(s, chr(10))) end as k from sets),
classes as materialized (select k, min(doc_id) as id, count(*) as n_in_class, any_value(n) as n, any_value(s) as s from keyed where k is not null group by k),
each as materialized (select k, n, unnest(s) as x from classes),
ranked as (select k, n, x, row_number() over (partition by k order by often, x) as place from (select *, count(*) over (partition by x) as often from each)),
rare as materialized (select k, n, x from ranked where place <= n - (n * {percent} + 99) // 100 + 1),
candidates as (select distinct a.k as a, b.k as b, a.n as na, b.n as nb from rare a join rare b on a.x = b.x and a.k < b.k and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent}),
near as (select c.a, c.b from candidates c join each x on x.k = c.a join each y on y.k = c.b and y.x = x.x group by c.a, c.b, c.na, c.nb having 100 * count(*) >= {percent} * (c.na + c.nb - count(*))),
one_id as (select distinct a.k as a, b.k as b from keyed a join keyed b on a.doc_id = b.doc_id and a.k <> b.k),
links as materialized (select a, b from near union select b, a from near union select a, b from one_id),
reach as (select k, k as r from classes union select reach.k, links.b from reach join links on links.a = reach.r),
placed as (select reach.k, min(c.id) as m from reach join classes c on c.k = reach.r group by reach.k),
of_id as (select doc_id, min(m) as m, max(n_in_class) as n_in_class from keyed join placed using (k) join classes using (k) group by doc_id)
select d.doc_id, d.n as n_shingles, coalesce(o.m, d.doc_id) as component_id, d.doc_id = coalesce(o.m, d.doc_id) as kept, coalesce(o.n_in_class, 1) as n_in_class
from keyed d left join of_id o on o.doc_id = d.doc_id"""
