"""Each operator against a brute-force version, and on odd tables."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelane.llm import chat, common, components, katz, langid, linededup, media, merkle, mixing, packing, pii, setsketch, words


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


# --- op1


def brute_base(text):
    out = []
    for kind, pattern in enumerate(
        [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2:
                total = sum(d if i % 2 == 0 else (2 * d if 2 * d < 10 else 2 * d - 9) for i, d in enumerate(int(c) for c in reversed(digits)))
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize(
    "text",
    [
        "a@b.cd@e.f x@y.z.@q.r @a.b a@@b.c a@b-.c- ü@b.cd",
        "1.2.3.4.5.6.7.8.9 256.1.1.1.1 001.2.3.4 1..2.3.4.5 1.2.3.40000",
        "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 49927398716 0000000000000000",
        "+1 (383) 555-6083 +12 +1--------2 +44 20 7946 0958. ++49 (0)30.1234567) +1234567890123456",
        "",
        " +1 555 555 0100\U0001f600 me@x.org",
    ],
)
def test_base_spans(text):
    assert pii.base_spans(text) == sorted(brute_base(text))


def test_base_spans_of_documents(small):
    for _, text in rows_of(small):
        assert pii.base_spans(text) == sorted(brute_base(text))


def test_long_runs_take_linear_time():
    for text in ("1" * 100_000, "a" * 100_000, "1.1." * 30_000, "+1" * 50_000, "a@" * 50_000):
        pii.base_spans(text)


def test_field_spreads_labels(spark):
    text = "Call +1 (578) 555-6437 today. " + "words " * 50 + "or dial 5785556437 now; room 12 seats 3400, mail jo.smith.77@mail2.example.com or jo.smith.77@mail2 please"
    docs = spark.createDataFrame([(1, text), (2, "number 5785556437 alone"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    at = text.index("5785556437")
    assert f"phone:{at}:{at + 10}" in got[1].spans.split(",")
    at = text.index("jo.smith.77@mail2 ")
    assert f"email:{at}:{at + 17}" in got[1].spans.split(",")
    assert got[1].n_added == 2 and got[1].n_phone == 1 and got[1].n_email == 1
    assert got[2].spans == got[3].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_spaced_phones_and_long_mailboxes_are_added(spark):
    box = "name" * 30
    texts = ["call +1 (487) 555-7209 now. Later (487) 555-7209, or 555-7209, or in 2019 487 555 7209; not 12 34 56.", f"mail {box}@x.org now, later {box}@x", "a +1 (487) 555-7209 b"]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {texts[0][int(s) : int(e)] for _, s, e in (x.split(":") for x in got[0].split(","))} == {"+1 (487) 555-7209", "(487) 555-7209", "555-7209", "487 555 7209"}
    assert pii.tokens(texts[1], pii.base_spans(texts[1]))[1][0] == texts[1].rindex(box)


def test_messages_agree_with_enumeration():
    """On a tree, loopy message passing is exact."""
    rng = np.random.default_rng(0)
    u = rng.normal(size=(3, 5))
    got = pii.skip_chain(u, np.array([[0, 1]]), np.array([1, 2]), np.array([0, 0]), 1)
    p = np.zeros((3, 5))
    for a in range(5):
        for b in range(5):
            for c in range(5):
                for h in range(5):
                    w = math.exp(u[0, a] + u[1, b] + u[2, c] + 0.5 * (a == b) + pii.SKIP * (b == h) + pii.SKIP * (c == h))
                    p[0, a] += w
                    p[1, b] += w
                    p[2, c] += w
    assert np.allclose(got, p / p.sum(axis=1, keepdims=True), atol=1e-2)


def test_pii_odd(odd, empty, clashing, spark):
    got = {r.doc_id: r for r in pii.find(odd).collect()}
    assert len(got) == 10 and got[2].spans == got[3].spans == "" and pii.find(odd).count() == 11
    assert pii.find(empty).count() == 0 and pii.find(clashing).count() == 11
    zeros = spark.createDataFrame([(None, "0" * 6000 + ".1.1.1 " + "1.1.1." + "0" * 5000 + "9")], "doc_id long, text string")
    assert pii.find(zeros).first().n_ip == 2


def test_field_adds_what_is_supported_and_no_refused_pattern(spark):
    """Planted repeats are found, the same words without support are left alone, in whatever order and batch they come."""
    rows, want = [], set()
    for i in range(60):
        number = f"{2125550100 + 7 * i}"
        full = f"+1 ({number[:3]}) {number[3:6]}-{number[6:]}"
        text = f"Reach me: {full} in room {i + 100}. " + "some words here " * (i % 5) + f"dial {number} or pay 4111 1111 1111 {1112 + i % 7} by {1900 + i}"
        rows.append((i, text))
        want.add((i, "phone", text.index(f"dial {number}") + 5))
    rows += [(100 + i, f"order {5000000000 + i} of 4111111111111112 at 300.1.1.1 in {1900 + i}") for i in range(60)]
    base = {i: {(pii.KINDS[k], s) for k, s, _ in pii.base_spans(t)} for i, t in rows}
    one = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    two = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7)).collect()}
    assert one == two
    added = {(i, k, int(s)) for i, spans in one.items() for k, s, _ in (x.split(":") for x in spans.split(",") if x) if (k, int(s)) not in base[i]}
    assert added == want


# --- op2


def brute_katz(train, texts):
    tok = lambda t: [*words_of(t), None]
    uni, bi = Counter(), Counter()
    for t in train:
        w = tok(t)
        uni.update(w)
        bi.update(zip([None, *w], w))
    total, n_u, n_b = sum(uni.values()), Counter(uni.values()), Counter(bi.values())
    d_u, d_b = katz.discounts(n_u), katz.discounts(n_b)
    disc = lambda d, c: c * (d[c] if c <= katz.K else 1)
    kept = sum(disc(d_u, c) for c in uni.values()) / total
    p1 = lambda w: disc(d_u, uni[w]) / total if w in uni else 1 - kept
    follow = defaultdict(dict)
    for (h, w), c in bi.items():
        follow[h][w] = c
    out = []
    for t in texts:
        w, s, b = tok(t), 0.0, 0.0
        for h, x in zip([None, *w], w):
            b += math.log10((uni.get(x, 0) + 1) / (total + len(uni) + 1))
            f = follow.get(h)
            if not f:
                s += math.log10(p1(x))
                continue
            c = sum(f.values())
            k = sum(disc(d_b, v) for v in f.values()) / c
            scale = 1.0 if k < 1 - 1e-12 else c / (c + 1)
            if x in f:
                s += math.log10(scale * disc(d_b, f[x]) / c)
            else:
                s += math.log10((1 - k * scale) / (1 - sum(p1(y) for y in f)) * p1(x))
        out.append((len(w), sum(x in uni for x in w), total, b, s))
    return out


@pytest.mark.parametrize("chunk_words", [500, 10**6])
def test_katz(small, spark, chunk_words):
    docs = small.unionByName(spark.createDataFrame([(1000, None), (1001, "never seen words here"), (1002, "\n")], "doc_id long, text string"), allowMissingColumns=True)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rows = rows_of(docs)
    want = dict(zip([i for i, _ in rows], brute_katz([t for i, t in rows if not held(i)], [t for _, t in rows]), strict=True))
    got = katz.scored(docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).alias("held_out"), "text"), chunk_words).collect()
    assert len(got) == len(rows) and any(r.held_out for r in got)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-6)


def test_katz_sums_to_one():
    counts = np.array([[3.0, 1, 0, 0, 0, 0, 0.3], [0, 0, 0, 0, 0, 40, 0.2], [1, 0, 0, 0, 0, 0, 1.0]])
    d = katz.discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5})
    count, scale, alpha = katz.history(counts, d)
    kept = ((counts[:, :5] * np.arange(1, 6) * d[1:]).sum(axis=1) + counts[:, 5]) * scale / count
    assert np.allclose(kept + alpha * (1 - counts[:, 6]), 1)


def test_katz_odd(odd, empty, clashing):
    assert {r.doc_id: r.n_tokens for r in katz.score_documents(odd).collect()}[2] == 1
    assert katz.score_documents(clashing).count() == 11
    assert katz.score_documents(empty).count() == 0


def test_word_codes(small):
    texts = [t for _, t in rows_of(small)] + ["", None, " A b\x0bÉ\x85x "]
    codes, counts = words.word_codes(texts)
    flat = [w for t in texts for w in words_of(t)]
    assert counts.tolist() == [len(words_of(t)) for t in texts]
    assert len(dict(zip(flat, codes.tolist(), strict=True))) == len(set(codes.tolist())) == len(set(flat))


# --- op3


def test_packing(small, odd, empty, clashing):
    caps = (64, 128, 256)
    for docs in (small, odd, clashing):
        got = packing.pack(docs, caps, shard_docs=50).collect()
        sizes = Counter((i, len(words_of(t))) for i, t in rows_of(docs))
        by_doc = Counter()
        bins = defaultdict(list)
        for r in got:
            by_doc[r.doc_id] += r.piece_words
            if r.bin_id is None:
                assert r.piece_words == 0
            else:
                bins[r.bin_id].append(r)
        want = Counter()
        for (i, n), k in sizes.items():
            want[i] += n * k
        assert by_doc == want
        for own in bins.values():
            own.sort(key=lambda r: r.bin_offset)
            at = 0
            for r in own:
                assert r.bin_offset == at
                at += r.piece_words
            assert at == own[0].bin_words and own[0].bin_capacity == min(c for c in caps if c >= at)
    assert packing.pack(empty).count() == 0


def brute_best_fit(lengths, caps, opening):
    open_, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if not n:
            continue
        spare = sum(c - u for c, u in open_)
        filler = {c: max(0, sum(lengths[j] for j in range(len(lengths)) if j not in where and j != i and lengths[j] <= c - n) - spare) for c in caps if c >= n}
        fits = [b for b in range(len(open_)) if open_[b][0] - open_[b][1] >= n]
        if fits:
            b = min(fits, key=lambda b: (open_[b][0] - open_[b][1], b))
        else:
            open_.append([packing.opening_size(n, filler, caps, opening), 0])
            b = len(open_) - 1
        open_[b][1] += n
        where[i] = b
    return where, [min(c for c in caps if c >= u) for _, u in open_]


def test_best_fit_agrees_with_a_plain_version():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(0, 200, 60).tolist()
        where, _, capacity = packing.best_fit(lengths, (64, 128, 200), 16)
        want, caps = brute_best_fit(lengths, (64, 128, 200), 16)
        assert {i: b for i, b in enumerate(where) if b >= 0} == want and capacity == caps


def test_sizes_are_traded():
    """Several sizes are opened, and less is padded than with the largest alone."""
    rng = np.random.default_rng(4)
    caps, opened = packing.CAPACITIES, []
    lengths = [*rng.integers(900, 2600, 900).tolist(), *rng.integers(5, 200, 400).tolist()]
    size = packing.opening_size

    def noted(*a):
        opened.append(size(*a))
        return opened[-1]

    packing.opening_size = noted
    try:
        total = sum(packing.best_fit(lengths)[2])
    finally:
        packing.opening_size = size
    single = sum(packing.best_fit(lengths, (max(caps),))[2])
    assert len(set(opened)) >= 2 and total < single


def test_repeated_rows_are_dealt(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 1000 + [(2, "d")], "doc_id long, text string")
    got = packing.pack(docs, (8, 16), shard_docs=100).collect()
    assert len(got) == 1001 and len({r.bin_id.split("-")[0] for r in got}) > 1


# --- op4


def test_viterbi_in_blocks_is_the_whole_path(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    one = turns.withColumn("turn", F.row_number().over(__import__("pyspark").sql.Window.orderBy("conv_id", "turn")).cast("long") - 1).withColumn("conv_id", F.lit(7).cast("long"))
    model = chat.learn(turns)
    raw = chat.transcripts(one).select("conv_id", "turn", "text").cache()
    cut = chat.parse(raw, model, block_lines=7).collect()
    whole = chat.parse(raw, model, block_lines=10**6).collect()

    def ordered(rows):
        return sorted(rows, key=lambda r: (r.block, r.piece))

    assert len({r.block for r in cut}) > 10 and [r.role for r in ordered(cut) for _ in range(r.n_lines)] == [r.role for r in ordered(whole) for _ in range(r.n_lines)]
    assert "\n".join(r.rendered for r in ordered(cut)) == "\n".join(r.rendered for r in ordered(whole)) and all(r.begins for r in whole)


def test_parsed_conversations_are_the_best_paths(spark):
    """The query's rows against a plain Viterbi over each whole conversation."""
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    held = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2
    raw = chat.transcripts(turns)
    model = chat.learn(raw.where(~held))
    lines = defaultdict(list)
    for r in chat.features(raw).collect():
        lines[r.conv_id].append((r.turn, r.line_no, r.look, chat.MARKS.index(r["mark"])))
    want = set()
    for conv, own in lines.items():
        own.sort()
        v, back = None, []
        for _, _, look, mark in own:
            e = model["emit"][:, look] + model["mark"][:, mark]
            if v is None:
                v = model["start"] + e
            else:
                back.append([max(range(6), key=lambda a: v[a] + model["move"][a, b]) for b in range(6)])
                v = np.array([max(v[a] + model["move"][a, b] for a in range(6)) for b in range(6)]) + e
        path = [int(v.argmax())]
        for b in reversed(back):
            path.append(b[path[-1]])
        path.reverse()
        at = [k for k, st in enumerate(path) if chat.STATES[st][1]] + [len(path)]
        want |= {(conv, chat.ROLES[chat.STATES[path[a]][0]], own[a][0], b - a) for a, b in zip(at, at[1:])}
    got = chat.parse_conversations(turns).collect()
    assert {(r.conv_id, r.role, r.first_turn, r.n_lines) for r in got} == want and len(got) == len(want)


def test_roles_make_no_part_of_transcripts(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    other = turns.withColumn("role", F.lit("user"))
    a, b = ({(r.conv_id, r.turn): r.text for r in chat.transcripts(t).collect()} for t in (turns, other))
    assert a == b


def test_named_markers_are_read(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    text = "System: Be kind.\nHuman: Where is it?\nI lost it.\n[assistant]: Over there, behind the house.\nUser: Thanks."
    got = chat.parse(spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string"), chat.learn(chat.transcripts(turns))).orderBy("piece").collect()
    assert [r.role for r in got] == ["system", "user", "assistant", "user"] and got[1].rendered == "<|user|>\nWhere is it?\nI lost it.\n<|end|>"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    n = len(chat.STATES)
    model = {"start": rng.normal(size=n), "move": rng.normal(size=(n, n)), "emit": None}
    e = rng.normal(size=(5, n))
    path, v = chat.viterbi(model, e)
    best = max(
        ((model["start"][p[0]] + e[0, p[0]] + sum(model["move"][p[t - 1], p[t]] + e[t, p[t]] for t in range(1, 5)), p) for p in np.ndindex(*[n] * 5)), key=lambda x: x[0]
    )
    assert tuple(path) == best[1] and v.max() == pytest.approx(best[0])


def test_chat_recovers_roles(spark):
    """From lines and unnamed dashes alone; always guessing the commonest role is right for about half."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = chat.parse_conversations(turns).where("held_out and begins").collect()
    assert sum(bool(r.right) for r in got) / len(got) > 0.7


def test_chat_odd(spark):
    schema = "conv_id long, turn long, role string, text string, line string"
    turns = spark.createDataFrame([(1, 0, "user", None, "z"), (1, 1, "assistant", "", "z"), (None, None, None, "x", "z"), (1, 0, "user", None, "z"), (2, 5, "user", "a\n" * 3000, "z")], schema)
    assert chat.parse_conversations(turns).count() > 0
    assert chat.parse_conversations(spark.createDataFrame([], schema)).count() == 0


# --- op5


def brute_targets(sizes, weights, share, epochs):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > epochs * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = epochs * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(small, odd, clashing, empty):
    for docs in (small, odd, clashing):
        sizes, own = Counter(), Counter()
        for r in docs.select("source", "text").collect():
            sizes[r.source] += len(words_of(r.text))
        want = brute_targets(sizes, (5, 2, 1), 1.5, 2)
        source_of = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
        got = mixing.mix(docs).collect()
        assert len(got) == docs.count() and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
        for r in got:
            s = source_of[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6) and 0 <= r.taken <= 2 * r.size
            own[s] += r.taken
        assert all(abs(own[s] - want[s]) <= 1 for s in sizes)
    assert mixing.mix(empty).count() == 0


def by_sql(sql, docs):
    """Rows of DuckDB's SQL over ``docs`` as documents."""
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    return sorted(map(tuple, con.sql(sql).fetchall()), key=repr)


def test_mixing_agrees_with_its_sql(spark, small, odd, clashing):
    # many equal rows, of a null id too, fall into several lots
    alike = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b").otherwise("a b c").alias("text"), F.lit("s").alias("source"))
    for docs in (small, odd, clashing, alike.unionByName(odd.select("doc_id", "text", "source"))):
        got = mixing.mix(docs)
        assert sorted(map(tuple, got.collect()), key=repr) == by_sql(mixing.sql(), docs)


def test_mixed_documents(small, clashing):
    taken = sum(r.taken for r in mixing.mix(small).collect())
    got = mixing.mixed_documents(small)
    assert got.columns == small.columns and sum(len(words_of(t)) for _, t in rows_of(got)) == taken
    assert mixing.mixed_documents(clashing).columns == clashing.columns


# --- op6


def test_jpeg_round_trip(small, odd):
    payloads = [(t or "").encode() for _, t in rows_of(small) + rows_of(odd)] + [bytes(range(256)) * 8, b"\xff" * 640, b"\0" * 64]
    payloads = [p + bytes(-len(p) % 64 if p else 64) for p in payloads]
    images = media.encode(payloads)
    assert [t.tobytes() for t in media.thumbnails(images)] == payloads
    assert [media.thumbnails([i])[0].tobytes() for i in images[:20]] == payloads[:20]
    tall = np.random.default_rng(0).integers(0, 256, 64 * 8200).astype(np.uint8).tobytes()
    assert media.thumbnails(media.encode([tall]))[0].tobytes() == tall


def test_general_decoder_agrees_with_the_quick_one(small, monkeypatch):
    payloads = [t.encode() + bytes(-len(t.encode()) % 64) for _, t in rows_of(small)[:20]]
    monkeypatch.setattr(media, "_dc_only", lambda *_: None)
    assert [t.tobytes() for t in media.thumbnails(media.encode(payloads))] == payloads


def test_media_queries(odd, empty, clashing):
    got = {r.doc_id: r for r in media.features(media.to_media(odd)).collect()}
    for i, t in rows_of(odd):
        raw = (t or "").encode()
        raw_padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(raw_padded), hashlib.sha256(raw_padded).hexdigest(), zlib.crc32(raw_padded[-64:]))
    assert media.features(media.to_media(empty)).count() == 0 and media.to_media(clashing).count() == 11
    with pytest.raises(ValueError):
        media.thumbnails([b"no image"])


def test_null_and_broken_media_cost_their_own_row(spark, small):
    good = media.to_media(small.where("doc_id < 5"))
    kind = "doc_id long, n_bytes long, media binary"
    bad = spark.createDataFrame([(900, 0, None), (901, 8, b"no image"), (902, 4, b"\xff\xd8\xff"), (903, 0, b"")], kind)
    got = {r.doc_id: r for r in media.features(good.unionByName(bad).coalesce(1)).collect()}
    want = {r.doc_id: r for r in media.features(good).collect()}
    assert all(got[i] == r and r.error is None for i, r in want.items())
    assert all(got[i].payload_sha256 is None and got[i].error for i in (900, 901, 902, 903)) and got[900].media_bytes is None


# --- op7


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.predictions(docs).where("held_out").collect()
    assert sum(r.lang_pred == true[r.doc_id] for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_mixture_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, logp = langid.learn(docs)
    by = {r.lang: r.text for r in docs.where("length(text) > 3000").dropDuplicates(["lang"]).collect()}
    both = by["de"][:2000] + " " + by["es"][:1000]
    share, chosen = langid.choose(langid.gram_counts([both, by["fr"][:2000]]), logp)
    assert {langs[i] for i in np.flatnonzero(chosen[0])} == {"de", "es"} and 0.55 < share[0, langs.index("de")] < 0.8
    assert [langs[i] for i in np.flatnonzero(chosen[1])] == ["fr"]


def test_em_does_not_lower_the_likelihood():
    rng = np.random.default_rng(2)
    logp = np.log(rng.dirichlet(np.ones(langid.GRAMS), size=3))
    x = rng.integers(0, 2, (4, langid.GRAMS))
    likes = [langid.mixture(x, logp, np.ones((4, 3)), steps)[1] for steps in range(1, 8)]
    assert all((b >= a - 0.5).all() for a, b in zip(likes, likes[1:]))


def test_texts_count_alike_in_any_batch(small):
    texts = [t for _, t in rows_of(small)][:60] + ["one", "", "zwei", "  tre  ", "x"]
    batch = langid.gram_counts(texts)
    assert all((batch[i] == langid.gram_counts([t])[0]).all() for i, t in enumerate(texts))

    def brute(text):
        b = re.sub(rb"[^A-Za-z\x80-\xff]+", b" ", b" " + text.lower().encode() + b" ")
        out = np.zeros(langid.GRAMS, dtype=np.int64)
        for k in range(len(b) - 2):
            code = (((b[k] * 65599 + b[k + 1]) * 65599 + b[k + 2]) % 2**32 * 2654435761) % 2**32 >> 20
            out[code] += 1
        return out

    assert all((batch[i] == brute(t)).all() for i, t in enumerate(texts))


def test_predictions_agree_with_a_plain_version(spark):
    """Learning, mixture and choice of the set, one text at a time, over every subset of languages."""
    from itertools import combinations

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = docs.select("doc_id", "text", "lang").collect()
    langs = sorted({r.lang for r in rows if r.lang})
    table = np.full((len(langs), langid.GRAMS), 0.5)
    for r in rows:
        if not held(r.doc_id) and r.lang:
            table[langs.index(r.lang)] += langid.gram_counts([r.text])[0]
    logp = np.log(table / table.sum(axis=1, keepdims=True))
    got = {r.doc_id: r for r in langid.predictions(docs).collect()}
    agree = 0
    for r in rows:
        x = langid.gram_counts([r.text])[0].astype(float)
        best = None
        for k in range(1, len(langs) + 1):
            for some in combinations(range(len(langs)), k):
                share = np.full(k, 1 / k)
                for _ in range(300 if k > 1 else 0):
                    mix = share @ np.exp(logp[list(some)])
                    new = share * (np.exp(logp[list(some)]) @ (x / mix)) / x.sum()
                    if np.abs(new - share).max() < 1e-5:
                        break
                    share = new
                like = (x * np.log(share @ np.exp(logp[list(some)]))).sum() - (k - 1) * 0.5 * np.log(x.sum())
                if best is None or like > best[0] + 1e-6:
                    best = like, langs[some[int(share.argmax())]], {langs[i] for i in some}
        agree += best[1] == got[r.doc_id].lang_pred and best[2] == set(got[r.doc_id].lang_set.split(","))
    assert agree >= 0.98 * len(rows)


def test_language_odd(odd, empty, clashing):
    got = {r.doc_id: r for r in langid.predictions(odd).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4, 7)] == ["und"] * 4 and got[2].score == 0
    assert langid.predictions(empty).count() == 0
    kept = langid.accepted(clashing)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} <= {1, 5, 6, 8, 9, 10}


# --- op8


def test_merkle(small, odd, empty, clashing):
    for docs in (small.where("doc_id % 3 = 0"), odd, small.where("doc_id = 5"), clashing):
        rows = sorted(((i, t or "") for i, t in rows_of(docs)))
        got = sorted((r for r in merkle.fingerprints(docs).collect()), key=lambda r: r.doc_id)
        assert [r.doc_id for r in got] == [i for i, _ in rows]
        for k, ((i, t), r) in enumerate(zip(rows, got, strict=True)):
            after = rows[(k + 1) % len(rows)][1]
            new = merkle.edited(t, after)
            a, b, c = merkle.Tree(t), merkle.Tree(new), merkle.Tree(after)
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), a.root.hex(), b.root.hex())
            assert r.near_edited == merkle.likeness(a, b) and r.near_next == merkle.likeness(a, c)
    assert merkle.fingerprints(empty).count() == 0


def test_branches_locate_all_edits():
    lines = [f"Paragraph number {i} says something about the topic." for i in range(60)]
    new = [*lines[:5], *lines[6:25], "An edit.", *lines[26:40], "One more paragraph.", *lines[40:]]
    a, b = merkle.Tree("\n".join(lines)), merkle.Tree("\n".join(new))
    place = lambda tree, x: sum(len(k) for k in tree.shape[: int(x[1:].split("/")[0])]) + int(x.split("/")[1])
    got = merkle.differences(a, b)
    gone = {place(a, x) for x in got if x[0] in "=-"}
    come = {place(b, x) for x in got if x[0] == "+"}
    assert {5, 25} <= gone and 39 in come and len(gone) + len(come) <= 4 and 0.9 < merkle.likeness(a, b) < 1
    assert merkle.differences(a, merkle.Tree("\n".join(lines))) == [] and merkle.Tree("").root == merkle.Tree("").root


def test_roots_and_likeness_agree_with_a_plain_version(small):
    """Leaves, paragraphs, sections and root hashed anew, without the tree's own code."""
    h = lambda x: hashlib.blake2b(x, digest_size=16).digest()

    def plain(text):
        leaves, sections, own = Counter(), [], []
        lines = text.split("\n") if text else []
        for i, line in enumerate(lines):
            at, kids = 0, b""
            while at < len(line):
                end = min(len(line), at + 160)
                for k in range(at + 24, min(len(line) - 1, at + 161)):
                    if line[k] in ".,;:!?dsy" and line[k + 1] in " \t":
                        end = k + 2
                        break
                d = h(line[at:end].encode())
                leaves[d] += end - at
                kids, at = kids + d, end
            own.append(h(b"p" + kids))
            if not line or own[-1][0] % 8 == 0 or i == len(lines) - 1:
                sections.append(h(b"s" + b"".join(own)))
                own = []
        return h(b"r" + b"".join(sections)), leaves

    rows = sorted(rows_of(small.where("doc_id < 80")))
    got = {r.doc_id: r for r in merkle.fingerprints(small.where("doc_id < 80")).collect()}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        (a, x), (b, y), (c, z) = plain(t), plain(t[: len(t) - n] + after[:n]), plain(after)
        like = lambda p, q, u, v: 1.0 if u == v else 2 * (p & q).total() / (p.total() + q.total())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (a.hex(), b.hex())
        assert got[i].near_edited == pytest.approx(like(x, y, a, b)) and got[i].near_next == pytest.approx(like(x, z, a, c))


# --- op9


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def groups_of(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_groups_find_what_edit_similarity_links(spark):
    """Recall against brute force over all pairs, with no filter ahead of it."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9)))
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.integers(4, 30))]
        other = list(w)
        for k in rng.choice(len(w), max(1, len(w) // 10), replace=False):
            other[k] = word()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.group_id for r in linededup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links = [(a, b) for a, x in rows for b, y in rows if a < b and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and edit_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9]
    assert len(links) > 40 and sum(got[a] == got[b] for a, b in links) >= 0.95 * len(links)
    whole = groups_of([a for a, _ in rows], links)
    assert all(whole[a] == whole[b] for a in got for b in got if got[a] == got[b])


def test_numbers_signs_and_marks_of_lines_count(spark):
    texts = ["Price: 10", "Price: 99", "reouti anatha. 19.37.233.111", "reouti anatha.", "555 0100", "555 0100", "-----", " ----- ", "\u0915\u093f", "\u0915\u0940", "", "  Price:\t10"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id: r.text for r in linededup.without_repeats(docs).collect()}
    assert [i for i, x in enumerate(texts) if left[i] != x] == [5, 7, 11]


def test_recall_of_lines_on_documents(spark, small):
    """Against edit similarity over all pairs of distinct lines below 700 characters, with nothing ahead of it that loses a pair."""
    got = linededup.near_groups(small).collect()
    text = {i: t for i, t in rows_of(small)}
    norm = {" ".join(text[r.doc_id].split("\n")[r.line_no].lower().split()): r.group_id for r in got}
    lines = sorted(x for x in norm if len(x) < 700)
    size = np.array([len(x) for x in lines])
    has = np.zeros((len(lines), 8192), dtype=np.float32)
    for i, x in enumerate(lines):
        has[i, [hash(x[k : k + 3]) % 8192 for k in range(len(x) - 2)]] = 1
    lost = has.sum(axis=1)[:, None] - has @ has.T  # grams of one line that the other lacks: each edit breaks three at most
    longer = np.maximum(size[:, None], size[None, :])
    may = (np.minimum(size[:, None], size[None, :]) >= 0.8 * longer) & (lost <= 0.6 * longer) & (lost.T <= 0.6 * longer)
    pairs = [(int(i), int(j), lines[i], lines[j]) for i, j in zip(*np.nonzero(np.triu(may, 1)), strict=True)]
    linked = spark.createDataFrame(pairs, "i int, j int, a string, b string").where("levenshtein(a, b) <= 0.2 * greatest(char_length(a), char_length(b)) + 1e-9").collect()
    assert len(linked) >= 30 and sum(norm[r.a] == norm[r.b] for r in linked) >= 0.9 * len(linked)


def test_first_occurrences_are_kept(spark, small):
    got = linededup.near_groups(small).collect()
    first = {}
    for r in got:
        first[r.group_id] = min(first.get(r.group_id, (r.doc_id, r.line_no)), (r.doc_id, r.line_no))
    assert {(r.doc_id, r.line_no) for r in got if r.kept} == set(first.values())
    same = defaultdict(set)
    text = {i: t for i, t in rows_of(small)}
    for r in got:
        same[" ".join(text[r.doc_id].split("\n")[r.line_no].lower().split())].add(r.group_id)
    assert all(len(x) == 1 for x in same.values())


def test_large_buckets_lose_no_link(spark):
    """Many lines share a block; those that no hub joins still meet, across blocks of a bucket."""
    members = spark.createDataFrame([(7, i, i) for i in range(300)], "key long, id long, load long")
    links = {(i, i + 100) for i in range(100)}
    pairs = spark.createDataFrame(sorted(links), "la long, lb long")
    verify = lambda p: p.join(pairs, (p.a == pairs.la) & (p.b == pairs.lb)).select("a", "b")
    got = components.linked_components(members, lambda x, y: F.lit(True), lambda ids: (verify, None)).collect()
    assert {r.id: r.component for r in got} == {x: a for a, b in links for x in (a, b)}


def test_finer_keys_of_large_buckets_lose_no_link(spark):
    """Ids of one bucket that share half of their parts, and only these, still meet; a key of few ids stays as it is."""
    rng = np.random.default_rng(5)
    parts = {}
    for i in range(150):
        own = [int(x) for x in rng.integers(100, 400, 6)]
        parts[i] = {1, 2, *own}
        parts[i + 150] = {1, 2, *own[: len({*own}) // 2 + 1], *(int(x) for x in rng.integers(400, 700, 3))}
    table = spark.createDataFrame([(i, sorted(x)) for i, x in parts.items()], "id long, parts array<long>")
    rows = [(7, i, i, i) for i in parts] + [(8, 0, 0, 0), (8, 9, 9, 9)]
    rest = spark.createDataFrame(rows, "key long, id long, load long, component long")
    finer = components.finer(rest, lambda ids: table.join(ids, "id"))
    assert finer.where("key = 8").count() == 2 and finer.groupBy("id").count().where("count > 9").isEmpty()
    got = {(r.a, r.b) for r in components.pairs_in_blocks(finer, lambda x, y: F.lit(True), lambda _: F.lit(0)).collect()}
    half = {(a, b) for a in parts for b in parts if a < b and 2 * len(parts[a] & parts[b]) >= min(len(parts[a]), len(parts[b]))}
    assert len(half) > 100 and half <= got and len(got) < 0.25 * 300 * 299 / 2
    links = spark.createDataFrame(sorted(half), "la long, lb long")
    verify = lambda p: p.join(links, (p.a == links.la) & (p.b == links.lb)).select("a", "b")
    members = rest.where("key = 7").select("key", "id", "load")
    whole = components.linked_components(members, lambda x, y: F.lit(True), lambda ids: (verify, None), parts=lambda ids: table.join(ids, "id")).collect()
    assert {r.id: r.component for r in whole} == groups_of({x for p in half for x in p}, half)


def test_pairs_in_blocks_are_all_near_pairs_of_different_components(spark):
    """Every near pair once, whatever the components; a class is the logarithm of the load."""
    rng = np.random.default_rng(5)
    rows = [(7, i, int(rng.integers(50, 400)), int(rng.integers(0, 6)) * 1000 if i % 3 else i) for i in range(500)] + [(8, i, 100, 1) for i in range(40)] + [(9, 0, 100, 0), (9, 1, 124, 1), (9, 2, 126, 2)]
    rest = spark.createDataFrame(rows, "key long, id long, load long, component long")
    near = lambda x, y: F.least(x, y) * 1.25 >= F.greatest(x, y)
    got = [(r.a, r.b) for r in components.pairs_in_blocks(rest, near, lambda x: F.floor(F.log(x.cast("double")) / F.log(F.lit(1.26))).cast("long")).collect()]
    want = sorted((a, b) for k, a, x, c in rows for k2, b, y, d in rows if k == k2 and a < b and c != d and min(x, y) * 1.25 >= max(x, y))
    assert len(want) > 20_000 and sorted(got) == want
    assert sorted((r.a, r.b) for r in components.pairs_in_blocks(rest, near, lambda _: F.lit(3)).collect()) == want


def test_pairs_of_several_large_buckets_come_once(spark):
    """Ids that share many large buckets meet by one part, and ids of few parts still meet those of many."""
    rng = np.random.default_rng(6)
    parts = {i: {1, 2, 3, *(int(x) for x in rng.integers(10, 60, int(rng.integers(0, 7))))} for i in range(200)}
    parts |= {i: {int(x) for x in rng.integers(1, 12, 2)} for i in range(200, 230)}
    table = spark.createDataFrame([(i, sorted(x)) for i, x in parts.items()], "id long, parts array<long>")
    rest = spark.createDataFrame([(k, i, i, i) for k in (7, 8, 9) for i in parts], "key long, id long, load long, component long")
    finer = components.finer(rest, lambda ids: table.join(ids, "id"))
    got = [(r.a, r.b) for r in components.pairs_in_blocks(finer, lambda x, y: F.lit(True), lambda _: F.lit(0)).collect()]
    assert sorted(got) == sorted((a, b) for a in parts for b in parts if a < b and 2 * len(parts[a] & parts[b]) >= min(len(parts[a]), len(parts[b])))


def test_copies_of_one_component_cost_a_row_each(spark):
    """A bucket of many linked lines and few others makes no blocks times rows."""
    rows = [(7, i, 100, 0) for i in range(6400)] + [(7, 10_000 + i, 100, 10_000 + i) for i in range(3)]
    rest = spark.createDataFrame(rows, "key long, id long, load long, component long")
    pairs = components.pairs_in_blocks(rest, lambda x, y: F.lit(True), lambda _: F.lit(0))
    assert pairs.count() == 3 * 6400 + 3
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def shuffle_bytes(spark):
    """Bytes of shuffle files that Spark holds on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def files_in(folder):
    return {p for p in Path(folder).rglob("part-*") if p.is_file()}


def test_stored_tables_leave_no_shuffle_files(spark):
    """A long query stores many tables; what was shuffled for one is gone before the next."""
    before = shuffle_bytes(spark)
    common.stored(spark.range(200_000).groupBy(F.xxhash64("id").alias("k")).agg(F.max("id").alias("m")))
    for _ in range(50):
        if shuffle_bytes(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_bytes(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_scratch_tables_go_and_others_stay(spark):
    folder = common.shared_dir(spark).removeprefix("file:")
    before = files_in(folder)
    with common.scratch(spark):
        one = common.stored(spark.range(10))
        with common.scratch(spark):
            two = common.stored(one.select((F.col("id") * 2).alias("id")))
            three = common.stored(two.select((F.col("id") + 1).alias("id")), outside=True)
        four = common.stored(one.unionByName(three), outside=True)
        assert len(files_in(folder) - before) > 0
    assert sorted(r.id for r in four.collect()) == sorted([*range(10), *range(1, 21, 2)])
    left = {p for p in files_in(folder) - before if pq.ParquetFile(p).metadata.num_rows}
    assert sum(pq.ParquetFile(p).metadata.num_rows for p in left) == 20


def test_lines_leave_little_on_disk(spark, small):
    """Lines with their texts, buckets and pairs go before the result is read."""
    folder = common.shared_dir(spark).removeprefix("file:")
    before = files_in(folder)
    got = linededup.near_groups(small)
    left = sum(p.stat().st_size for p in files_in(folder) - before)
    assert left < 0.25 * sum(p.stat().st_size for p in [Path("/root/testdata/sf0.001/documents.parquet")])
    assert got.count() == linededup.whole_lines(small).count()


def test_rows_of_a_large_bucket_are_copied_seldom(spark):
    """Two thousand ids of one bucket, all apart, were copied 32 times each."""
    rest = spark.range(2000).select(F.lit(7).alias("key"), "id", F.col("id").alias("load"), F.col("id").alias("component"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffle_bytes(spark)
        assert components.pairs_in_blocks(rest, lambda x, y: x + y > 3994, lambda _: F.lit(0)).count() == 4
        assert shuffle_bytes(spark) - before < 450_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_pairs_in_turns_are_the_same(spark, small, monkeypatch):
    """More pairs than take their texts at once."""
    want = {tuple(r) for r in linededup.near_groups(small).collect()}
    monkeypatch.setattr(linededup, "PAIRS", 100)
    monkeypatch.setattr(linededup, "PAIRS_SHARE", 0)
    assert {tuple(r) for r in linededup.near_groups(small).collect()} == want


def test_lines_without_blanks_are_compared(spark):
    """One word a line: other scripts, addresses and codes, from five characters on."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(120):
        n = int(rng.integers(5, 120))
        chars = [chr(int(c)) for c in rng.integers(0x4E00, 0x4F00, n)]
        other = list(chars)
        for k in rng.choice(n, max(1, n // 12), replace=False):
            other[k] = "\u3042"
        rows += [(2 * i, "".join(chars)), (2 * i + 1, "".join(other))]
    rows += [(1000, "ab"), (1001, "ac"), (1002, "x" * 3000), (1003, "x" * 3000)]
    got = {r.doc_id: r.group_id for r in linededup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    linked = [i for i in range(0, 240, 2) if edit_distance(text[i], text[i + 1]) <= 0.2 * len(text[i])]
    assert len(linked) > 110 and sum(got[i] == got[i + 1] for i in linked) >= 0.95 * len(linked)
    assert len({got[i] for i in range(0, 240, 2)}) == 120 and got[1000] != got[1001] and got[1002] == got[1003]


def test_lines_of_any_length_are_compared_by_characters(spark):
    """Long lines are not linked by words, and no pair is refused for the number of words that have an edit."""
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    pairs = []
    for n, changed in [(20, 10), (80, 30), (6, 6), (90, 90), (40, 8), (100, 15), (3, 1)]:
        w = [word(int(rng.integers(5, 10))) for _ in range(n)]
        other = list(w)
        for k in rng.choice(n, changed, replace=False):
            other[k] = "#" + w[k][1:]  # one letter of a word
        pairs.append((" ".join(w), " ".join(other)))
    for n, share in [(90, 0.24), (90, 0.3), (90, 0.2), (30, 0.2), (30, 0.3), (30, 0.25)] * 2:
        w = [word(int(rng.integers(4, 12))) for _ in range(n)]
        other = [word(len(x)) if n // 4 <= i < n // 4 + share * n else x for i, x in enumerate(w)]  # whole words, one after another
        pairs.append((" ".join(w), " ".join(other)))
    pairs += [("a" * 900, "a" * 721), ("a" * 900, "a" * 719), ("ab", "ac"), ("aaaaa", "aaaab"), ("x y", "x y z")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, na string, nb string")
    for e in "ab":
        rows = rows.withColumn(f"c{e}", linededup.coded(F.col(f"n{e}"))).withColumn(f"l{e}", linededup.longest_word(F.col(f"n{e}")))
    want = {i for i, (a, b) in enumerate(pairs) if edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9}
    assert {r.i for r in linededup.similar(rows).collect()} == want and 10 < len(want) < len(pairs) - 5
    docs = [(2 * i + j, x) for i, p in enumerate(pairs[:7]) for j, x in enumerate(p)]
    got = {r.doc_id: r.group_id for r in linededup.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[8] == got[9] and got[10] == got[11]


def test_lines_take_few_jobs(spark, small):
    """What the driver holds grows with jobs and plans, so one hub a bucket has to do before blocks."""
    spark.sparkContext.setJobGroup("lines", "")
    linededup.near_groups(small).collect()
    spark.sparkContext.setJobGroup("others", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("lines")) < 78


def test_proofs_and_refusals_of_likeness_agree_with_the_plain_distance(spark):
    """Shifted, shortened and edited lines about the limit; what both lines share is written once in the plan."""
    rng = np.random.default_rng(12)
    letters = list("abcdefgh \u00e9")
    pairs = []
    for i in range(400):
        n = int(rng.integers(1, 160))
        a = list(rng.choice(letters, n))
        b = list(a[int(rng.integers(0, n // 4 + 1)) :]) if i % 3 == 0 else list(a)
        for _ in range(int(rng.integers(0, n // 3 + 1))):
            k = int(rng.integers(0, len(b) + 1))
            b[k : k + int(rng.integers(0, 2))] = rng.choice(letters, int(rng.integers(0, 2)))
        a, b = " ".join("".join(a).split()), " ".join("".join(b).split())
        if a and b:
            pairs.append((a, b) if i % 2 else (b, a))
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, na string, nb string")
    for e in "ab":
        rows = rows.withColumn(f"c{e}", linededup.coded(F.col(f"n{e}"))).withColumn(f"l{e}", linededup.longest_word(F.col(f"n{e}")))
    found = linededup.similar(rows)
    want = {i for i, (a, b) in enumerate(pairs) if edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9}
    assert {r.i for r in found.collect()} == want and 50 < len(want) < len(pairs) - 50
    assert found._jdf.queryExecution().analyzed().toString().count("left(") < 60


def test_components_of_any_shape(spark):
    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 4000 + i) for i in range(500)] + [(3, 3)]
    ids = {x for a, b in links if a != b for x in (a, b)}
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == groups_of(ids, [(a, b) for a, b in links if a != b])


def test_lines_odd(odd, empty, clashing):
    got = {(r.doc_id, r.line_no): r.kept for r in linededup.near_groups(odd).collect()}
    assert got[1, 0] and not got[6, 0] and not got[8, 1] and got[8, 0] and not any(d in (2, 3, 4) for d, _ in got) and got[7, 0]
    new = linededup.without_repeats(clashing)
    texts = {r.doc_id: r for r in new.collect()}
    assert new.columns == clashing.columns and texts[6].text == "" and texts[6].n_chars == 0 and texts[2].text is None and texts[8].text.endswith("Tür.") and texts[4].text == "   \n\t "
    assert linededup.near_groups(empty).count() == 0 and linededup.without_repeats(empty).count() == 0


# --- op10


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, groups_of(ids, links)


def test_near_duplicates(small, spark):
    chain, w = [], [f"w{i}" for i in range(120)]
    for i in range(40):  # each near the one before, the ends far apart
        w = w[:]
        w[i * 3] = f"new{i}"
        chain.append((1000 + i, " ".join(w)))
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame(chain, "doc_id long, text string"))
    for k, percent in ((3, 85), (5, 80)):
        sets, want = brute_components(rows_of(docs), k, percent)
        got = setsketch.linked(docs, k, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}
        assert len(set(want.values())) < len(want)


def test_an_id_with_two_texts_keeps_the_links_of_both(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(7, a), (7, b), (9, b + " end"), (8, a + " end"), (11, None), (11, a), (12, "")], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in setsketch.linked(docs, 3, 85).collect()}
    assert got == {7: (7, True), 8: (7, False), 9: (7, False), 11: (7, False), 12: (12, True)}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    whole, parts = setsketch.sketches([a]), setsketch.sketches([a[:300], a[300:]])
    assert (whole[0] == parts.max(axis=0)).all()
    near = []
    for _ in range(20):
        x = np.unique(rng.integers(0, 2**63, 1150).astype(np.uint64))
        s = setsketch.sketches([x[:1000], x[150:]])
        near.append(setsketch.joint_estimate(s[:1], s[1:], np.array([1000.0]), np.array([float(len(x) - 150)]))[0])
    assert abs(np.mean(near) - 850 / 1150) < 0.02


def test_near_duplicates_agree_with_their_sql(spark, small, odd):
    again = small.select("doc_id", F.concat("text", F.lit(" and more")).alias("text"), "source").where("doc_id % 3 = 0")  # ids with two texts
    for docs in (small, odd, small.select("doc_id", "text", "source").unionByName(again)):
        for words, percent in ((3, 85), (5, 80)):
            assert sorted(map(tuple, setsketch.linked(docs, words, percent).collect()), key=repr) == by_sql(setsketch.sql(words, percent), docs)


def test_near_duplicates_odd(odd, empty, clashing):
    got = {r.doc_id: r for r in setsketch.linked(odd, 3, 85).collect()}
    assert (got[2].n_shingles, got[2].component_id, got[2].kept) == (0, 2, True) and got[6].component_id == 1 and got[5].n_shingles == 1
    kept = setsketch.one_of_each(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 8, 9, 10, 10]
    assert setsketch.linked(empty).count() == 0


# --- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001")
        docs.write.parquet(out := str(tmp_path / stage.__name__))
        docs = spark.read.parquet(out)
        assert docs.columns == before.columns and docs.count() > 0
    words_in = sum(len(words_of(t)) for _, t in rows_of(docs))
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.piece_words for r in got) == words_in


def test_documents_lose_what_the_stages_decide(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    _, want = brute_components(rows_of(docs), 5, 80)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, c in want.items() if i == c}


def test_pipeline_on_odd_tables(spark, odd, empty, clashing):
    import corpus_pipeline

    for docs in (odd, clashing, empty):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns, docs = docs.columns, stage(spark, docs, "")
            assert docs.columns == columns
        assert (corpus_pipeline.pack(spark, docs, "").count() > 0) == (n > 0)
