"""Conversation repair, toxicity and centroid clustering against brute-force versions, and on odd tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import clustering, repair, toxicity

CONVERSATION = "conv_id long, turn long, role string, text string"


# --- conversation repair


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute_repair(rows):
    """By conversation: the contract's columns, the cheapest edits by trying every edit of every row from every state."""
    result = {}
    left = brute_damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        # state: the initials so far fit s?, (ua)*, with what is open
        ways = {"": (0, "", ())}

        def add(new, state, way):
            if state not in new or way < new[state]:
                new[state] = way

        def inserted(ways):
            for _ in range(3):
                new = dict(ways)
                for state, (c, a, t) in ways.items():
                    role = "assistant" if state == "u" else "user"
                    add(new, role[0], (c + 5, a + "I", (*t, f"{role}:")))
                ways = new
            return ways

        for (_, _, role, text), fault in zip(own, faults):
            new = {}
            for state, (c, a, t) in inserted(ways).items():
                add(new, state, (c + 2, a + "D", t))
                if fault in ("blank", "duplicate"):
                    continue
                c += 5 * (fault == "truncated")
                if (state, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    add(new, role[0], (c, a + "K", (*t, f"{role}:{text}")))
                other = "assistant" if state == "u" else "user"
                add(new, other[0], (c + 1, a + "R", (*t, f"{other}:{text}")))
            ways = new
        cost, audit, turns = min(w for s, w in inserted(ways).items() if s in ("", "a"))
        numbers = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        result[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())
    return result


def repaired_rows(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


def random_conversations(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?  ", "and then", "", " \t", None, "a:b.", "two\nlines.", "user: me."]
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([None, *range(longest)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_are_the_cheapest(spark, seed):
    rows = random_conversations(seed, 60, 9)
    df = spark.createDataFrame(rows, CONVERSATION)
    assert repaired_rows(repair.audits(df)) == brute_repair(rows)


def test_long_conversations_are_chained(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"Text {t}{rng.choice('.x')}") for t in range(900)] + [(1, 7, "user", "Same.")] * 400 + [(2, t, "user", "Same.") for t in range(50)]
    assert repaired_rows(repair.audits(spark.createDataFrame(rows, CONVERSATION))) == brute_repair(rows)


def test_repair_agrees_with_its_sql(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}'")
    want = {r[0]: r[1:] for r in con.sql(repair.sql()).fetchall()}
    assert repaired_rows(repair.audits(spark.read.parquet(path))) == want


def test_agenda_finalises_the_lightest_first(spark):
    items = [(repair.EMPTY, repair.USER, 0, "K"), (repair.EMPTY, repair.USER, 0, "D")], [(repair.USER, repair.ASSISTANT, 1, "R"), (repair.USER, repair.ASSISTANT, 1, "IK")]
    assert repair.chain([list(x) for x in items]) == (1, "DIK", [(repair.EMPTY, "D"), (repair.USER, "IK")])
    assert repair.chain([]) == (0, "", [])
    assert (repair.EMPTY, repair.EMPTY, 4, "DD") in repair.block_items("uu", "b-", (1, 1))


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "user: again?"), (1, 2, "assistant", ""), (1, 3, "assistant", "Fine."), (2, 0, "system", "Be kind."), (3, 0, "tool", None)]
    got = repair.repaired(spark.createDataFrame(rows, CONVERSATION)).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.role, r.text) for r in got] == [(1, "user", "user: again?"), (1, "assistant", "Fine.")]


def test_repair_of_odd_tables(spark):
    empty = repair.audits(spark.createDataFrame([], CONVERSATION))
    assert empty.count() == 0 and empty.columns[0] == "conv_id"
    odd = spark.createDataFrame([(None, None, None, None), (None, None, None, None), (4, -(2**62), "user", "x" * 100_000 + "."), (4, 2**62 + 1, "assistant", "ok.")], CONVERSATION)
    for c in ("n", "seq", "kind", "blk", "cost", "c_", "same"):
        odd = odd.withColumn(c, F.lit("x"))
    got = repaired_rows(repair.audits(odd))
    assert set(got) == {None, 4} and got[None][7] == hashlib.sha256(b"").hexdigest() and got[4][0] is None


# --- toxicity


def toxic_documents():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    rows = []
    for i in range(1500):
        parts = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(1, 12))]
        if i % 8 == 0:
            parts[rng.randrange(len(parts))] += rng.choice([" vilest", " zorkadom", " zorkaway"])
        rows.append((i, ". ".join(parts) + ".", int(i % 8 == 0)))
    return rows


def test_toxicity_is_learned_from_document_labels(spark):
    rows = toxic_documents()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.predictions(docs, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert {r[0] for r in held} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1}
    right = sum(got[i].predicted == y for i, _, y in held)
    assert right / len(held) >= 0.98
    for i, text, y in held:
        if y and got[i].predicted:  # the sentence with the word is located
            assert any(re.search("vilest|zorka", text[int(a) : int(b)]) for a, b in (s.split(":") for s in got[i].offending.split(",")))
    flipped = spark.createDataFrame([(r[0], 1 - r[2] if got[r[0]].held_out else r[2]) for r in rows], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in toxicity.predictions(docs, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_noisy_or_is_that_of_its_sentences(spark):
    docs = spark.createDataFrame([(1, "bad dog. good cat! bad bad"), (2, "good"), (3, None), (4, " .. 12 "), (5, "dog " * 30000)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, {"bad$": 3.0, "good": -1.0, "dog$": 0.5}, -2.0).collect()}
    p = [1 / (1 + np.exp(-z)) for z in (1.5, -3.0, 1.0)]
    assert got[1].score == pytest.approx(1 - np.prod([1 - x for x in p])) and [(s.start, s.end) for s in got[1].offending] == [(0, 7), (18, 26)]
    assert got[1].offending[0].chance == pytest.approx(p[0]) and (got[3].score, got[4].score, got[3].n_sentences) == (0, 0, 0)
    assert got[5].score == pytest.approx(1 / (1 + np.exp(1.5))) and got[2].score == pytest.approx(p[1])


def test_toxicity_of_odd_tables(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (5, None), (None, 1), (6, 0), (9, 0), (99, 1)], "doc_id long, toxic int")
    for docs in (odd, clashing):
        got = toxicity.predictions(docs, labels).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert all(r.score == 0 for r in got if r.doc_id in (2, 3, 4, 7))
    assert toxicity.predictions(empty, labels).count() == 0
    assert {r.score for r in toxicity.predictions(odd, labels.limit(0)).collect()} == {0.0}


# --- clustering


def brute_clusters(vectors, k, rounds, seed):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        for j, own in groups.items():
            centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    placed = [(i, *place(v)[::-1]) for i, v in kept]
    by = {}
    for _, c, d in placed:
        by[c] = by.get(c, 0) + d
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, by[c], sum(by.values()), hashes[c]) for i, c, d in placed)


def clustered(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clusters_are_those_of_all_comparisons(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(rng.integers(3), 0.3, 64)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 64) for i in range(40)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]  # ties, repeats, a null id
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 63 + [None]), (304, [1.0] * 63 + [float("nan")]), (305, [float("inf")] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = clustering.clusters(df, k=12)
    assert clustered(got) == brute_clusters(rows, 12, 5, 2)
    assert got.agg(F.avg("n_verified")).first()[0] < 6  # of 12: the filter rules most out


def test_few_none_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    few = [(i, [float(i)] * 64) for i in range(5)]
    assert clustered(clustering.clusters(spark.createDataFrame(few, schema))) == brute_clusters(few, 40, 5, 2)
    assert clustering.clusters(spark.createDataFrame([], schema)).count() == 0
    huge = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [float(clustering.LARGEST)] * 64)]
    got = {r.vec_id: r for r in clustering.clusters(spark.createDataFrame(huge, schema), k=1, rounds=0).collect()}
    assert len(got) == 3 and max(r.distance for r in got.values()) == 64 * (2 * clustering.LARGEST) ** 2


def test_the_filter_never_rules_out_the_nearest():
    rng = np.random.default_rng(9)
    for scale in (1, 1000, 1 << 26):
        v, c = rng.integers(-scale, scale + 1, (300, 64)), rng.integers(-scale, scale + 1, (30, 64))
        c[11] = c[3]
        axes = np.linalg.qr(rng.normal(size=(64, 64)))[0][:, :16]
        mean = v.mean(0)
        found, distance, tested = clustering.nearest(v, *clustering.rotated(v, mean, axes), c, *clustering.rotated(c, mean, axes))
        every = ((v[:, None, :] - c[None]) ** 2).sum(2)
        assert (found == every.argmin(1)).all() and (distance == every.min(1)).all() and 11 not in found
