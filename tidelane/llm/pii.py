"""Personal data: exact patterns first, then a skip-chain conditional random field over the tokens near them."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Rounds of loopy message passing, and how much of an old message stays.
ROUNDS, DAMPING = 8, 0.3
#: Texts whose field is solved at once.
TEXTS = 256
#: Log-potential of two tokens that share a key having one label.
SKIP = 3.0
#: Weight that one observed count of a label lacks in the learned potentials.
SMOOTH = 0.5
#: Hash values of the words before tokens, and how many tokens of average labels each is given beforehand.
CUES, CUE_PRIOR = 1024, 20.0
#: Least marginal of a label at which the field adds a span.
LEAST = 0.6

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[@0-9]\S*")
_NUMBERS = re.compile(r"[0-9(][0-9 ().-]*[0-9]")
_PIECE = re.compile(r"[^ ]+")
#: Signs around a token that are not part of it.
_EDGE = "<>()[]{},;:.!?\"'"
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _in_byte(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each is found from its ``@``, to the left as far as the last match, in linear time."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        left = text[floor:at]
        start = floor + len(left.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind, then start."""
    found = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    for m in _CHAIN.finditer(text):
        if m.group().count(".") >= 3:
            at, parts = m.start(), m.group().split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(_in_byte(p) for p in four):
                    found.append((1, at, end))
                at = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((3, *m.span()))
    return found


def shape(token: str) -> str:
    """Coarse look of a token, blind to what the patterns check: signs, dots and how many digits."""
    digits = len(_NOT_DIGIT.sub("", token))
    size = "0" if not digits else "1-3" if digits < 4 else "4-6" if digits < 7 else "7-11" if digits < 12 else "12-15" if digits < 16 else "16-19" if digits < 20 else "20-"
    letters = any(c.isalpha() for c in token)
    return f"{'@' * ('@' in token)}{'a' * letters}{'.' * min(3, token.count('.'))}{size}"


def keys(token: str) -> list[str]:
    """What a token shares with its repeats and near repeats: its digits, its address, its mailbox name."""
    out = []
    digits = _NOT_DIGIT.sub("", token)
    if len(digits) >= 7 and "@" not in token:
        out.append("d" + digits)
        if len(digits) >= 10:
            out.append("e" + digits[-10:])
        if len(digits) <= 15 and token.count(".") < 3:
            out.append("f" + digits[-7:])
    if "@" in token:
        whole = token.strip(_EDGE).lower()
        out.append("t" + whole)
        box, _, domain = whole.partition("@")
        if len(box) >= 6:
            out.append("b" + box + "@" + domain.split(".")[0])
    elif token.count(".") >= 3:
        out.append("i" + token.strip(_EDGE))
    return out


def spaced_repeats(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of numbers written with blanks that have all, the last ten or the last seven digits of a phone in ``base``."""
    known = set()
    for k, s, e in base:
        if KINDS[k] == "phone":
            digits = _NOT_DIGIT.sub("", text[s:e])
            known |= {digits, *(digits[-n:] for n in (10, 7) if len(digits) >= n)}
    out, last = [], 0
    if not known:
        return out
    for s, e in [*sorted((s, e) for _, s, e in base), (len(text), len(text))]:
        for m in _NUMBERS.finditer(text, last, s) if s > last else ():
            pieces = [(p.start(), p.end(), _NOT_DIGIT.sub("", p.group())) for p in _PIECE.finditer(text, m.start(), m.end())]
            free = 0
            for i, (start, _, digits) in enumerate(pieces):
                if i < free or not digits or (start and text[start - 1].isalnum()):
                    continue
                whole, found = digits, 0
                for j in range(i + 1, len(pieces)):
                    whole += pieces[j][2]
                    if len(whole) > 15:
                        break
                    if pieces[j][2] and whole in known and not text[pieces[j][1] : pieces[j][1] + 1].isalnum():
                        found = j
                if found:
                    out.append((start, pieces[found][1]))
                    free = found + 1
        last = max(last, e)
    return out


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of each token that holds a digit or an ``@``, and of each base span.

    A base span is one token with its label; what stands around it inside its blanks-free run is left out.
    A repeat of a base phone is one token, also over blanks. The rest gets label -1: the field decides.
    """
    spans = sorted([*((s, e, k + 1) for k, s, e in base), *((s, e, -1) for s, e in spaced_repeats(text, base))])
    out, last = [], 0
    for s, e, k in [*spans, (len(text), len(text), 0)]:
        if s > last:
            for m in _TOKEN.finditer(text, last, s):
                start = m.start()
                while start > last and not text[start - 1].isspace():
                    start -= 1
                out.append((start, m.end(), -1))
        if k and s >= last:
            out.append((s, e, k))
        last = max(last, e)
    return out


def cue(text: str, start: int) -> str:
    """The hashed word before a token, one of CUES: what words announce an address or a number is learned, not listed."""
    before = text[max(0, start - 40) : start].split()
    return f"cue{zlib.crc32(before[-1].lower().strip(_EDGE).encode('utf-8', 'surrogatepass')) % CUES}" if before else "cue"


def possible(token: str) -> np.ndarray:
    """Which labels a token without a base span may have by its own looks: a pattern that refuses it must not come back by a prior.

    An email needs an ``@``, an address of the network four parts up to 255, a card 16 to 19 digits that pass
    Luhn, a phone seven to 15 digits.
    """
    digits, bare = _NOT_DIGIT.sub("", token), token.strip(_EDGE)
    parts = bare.split(".")
    ip = len(parts) == 4 and all(p.isascii() and p.isdigit() and _in_byte(p) for p in parts)
    return np.array([True, "@" in bare.strip("@"), ip, 16 <= len(digits) <= 19 and luhn(digits), 7 <= len(digits) <= 15 and "@" not in bare])


def feature_counts(docs: DataFrame) -> dict[str, list[float]]:
    """How often a token of each shape, and after each cue, is a base span of each label, over all of ``docs`` (text).

    There are a few hundred shapes at most and CUES cues, so the table is small whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    for s, e, k in tokens(text, base_spans(text)):
                        for what in (shape(text[s:e]), cue(text, s)):
                            key = what, max(k, 0)
                            total[key] = total.get(key, 0) + 1
        yield pa.RecordBatch.from_pydict(
            {"shape": pa.array([k[0] for k in total], pa.string()), "label": pa.array([k[1] for k in total], pa.int32()), "n": pa.array(list(total.values()), pa.int64())}
        )

    rows = docs.select("text").mapInArrow(count, "shape string, label int, n long").groupBy("shape", "label").agg(F.sum("n").alias("n"))
    out: dict[str, list[float]] = {}
    for r in rows.collect():
        out.setdefault(r["shape"], [0.0] * len(LABELS))[r["label"]] += r["n"]
    return out


def potentials(counts: dict[str, list[float]]) -> dict[str, np.ndarray]:
    """Log-potentials of the labels by feature, learned piecewise: smoothed shares by shape, and by cue how much they exceed the shares of all tokens."""
    whole = sum((np.array(n) for s, n in counts.items() if not s.startswith("cue")), np.zeros(len(LABELS))) + SMOOTH
    every = np.log(whole / whole.sum())

    def share(n: list[float], weight: np.ndarray) -> np.ndarray:
        return np.log((np.array(n) + weight) / (sum(n) + weight.sum()))

    even = np.full(len(LABELS), SMOOTH)
    return {s: share(n, CUE_PRIOR * np.exp(every)) - every if s.startswith("cue") else share(n, even) for s, n in counts.items()}


def skip_chain(unary: np.ndarray, chain: np.ndarray, node: np.ndarray, hub: np.ndarray, n_hubs: int, stay: float = 0.5) -> np.ndarray:
    """Marginals of each token by loopy belief propagation.

    ``chain`` lists pairs of neighbouring tokens, which favour one label by ``stay``; ``node`` and ``hub`` list
    which token shares which key. A key's tokens all meet in a hub variable, favouring its label by SKIP, so a
    key of n tokens costs n edges, not n squared. Labels are few; messages are log-domain arrays, an edge a row.
    """
    n, labels = unary.shape
    u = np.concatenate([unary, np.zeros((n_hubs, labels))])
    a = np.concatenate([chain[:, 0], node])
    b = np.concatenate([chain[:, 1], hub + n])
    w = np.concatenate([np.full(len(chain), stay), np.full(len(node), SKIP)])[:, None]
    src, dst, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    msg = np.zeros((len(src), labels))

    def beliefs() -> np.ndarray:
        out = u.copy()
        np.add.at(out, dst, msg)
        return out

    gain = np.expm1(w)
    for _ in range(ROUNDS if len(src) else 0):
        pre = beliefs()[src] - msg[back]
        pre -= pre.max(axis=1, keepdims=True)
        e = np.exp(pre)
        new = np.log(e.sum(axis=1, keepdims=True) + gain * e)  # a Potts factor: one label, or any
        new -= new.max(axis=1, keepdims=True)
        msg = DAMPING * msg + (1 - DAMPING) * new
    out = beliefs()[:n]
    out = np.exp(out - out.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def label_texts(texts: list[str], learned: dict[str, np.ndarray]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text; the field runs over all texts of the batch at once."""
    base = [base_spans(t) if t else [] for t in texts]
    unary, chain, node, hub, ends, owner = [], [], [], [], [], []
    hubs: dict[tuple[int, str], int] = {}
    unknown = np.log(np.array([1.0] + [0.02] * len(KINDS)) / 1.08)
    for d, text in enumerate(texts):
        if not text:
            continue
        own = tokens(text, base[d])
        last = None
        for s, e, k in own:
            i, token = len(unary), text[s:e]
            if k > 0:
                u = np.full(len(LABELS), -30.0)
                u[k] = 0
            else:
                u = learned.get(shape(token), unknown) + learned.get(cue(text, s), 0.0)
                u = np.where(possible(token), u, u - 30.0)
            unary.append(u)
            ends.append((s, e, k))
            owner.append(d)
            if last is not None and s - ends[last][1] <= 2:
                chain.append((last, i))
            for key in keys(token):
                node.append(i)
                hub.append(hubs.setdefault((d, key), len(hubs)))
            last = i
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if unary:
        own_chain = np.array(chain, dtype=np.int64).reshape(-1, 2)
        p = skip_chain(np.array(unary), own_chain, np.array(node, dtype=np.int64), np.array(hub, dtype=np.int64), len(hubs))
        top = p.argmax(axis=1)
        for i in np.flatnonzero((top > 0) & (p.max(axis=1) >= LEAST)):
            s, e, k = ends[i]
            if k < 0:
                token = texts[owner[i]][s:e]
                lead = 0 if " " in token else len(token) - len(token.lstrip("<([{\"',;:.!?"))
                tail = len(token) - len(token.rstrip(">)]}\"',;:.!?"))
                added[owner[i]].append((int(top[i]) - 1, s + lead, e - tail))
    return list(zip(base, added, strict=True))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, learned: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of whole ``docs`` (doc_id, text).

    The patterns' spans always stay and are what the counts and the digest hold. The field is over tokens with
    a digit or an ``@``; all others are ``other`` for sure. Its potentials come from ``learned``, or are learned
    from all of ``docs``: shares of labels by shape and by the word before. What a pattern refuses (a card that
    fails Luhn, a part over 255) no potential brings back. Tokens in a document that share a key (digits, the last ten
    or seven digits, address, mailbox name) pull each other to one label, so a bare repeat of a number or address that is
    certain elsewhere is added to spans. Offsets are code points. Null text is empty; a row in, a row out;
    repeated rows repeat. Added spans cannot touch base ones.
    """
    model = potentials(feature_counts(docs)) if learned is None else learned

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (big.slice(i, TEXTS) for big in batches for i in range(0, big.num_rows, TEXTS)):
            out = label_texts(batch.column("text").to_pylist(), model)
            counts = [[sum(1 for x in base if x[0] == k) for base, _ in out] for k in range(len(KINDS))]
            cols = {"doc_id": batch.column("doc_id")}
            cols |= {f"n_{kind}": pa.array(counts[k], pa.int64()) for k, kind in enumerate(KINDS)}
            cols["base_sha256"] = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in out], pa.string())
            cols["spans"] = pa.array([written([*base, *more]) for base, more in out], pa.string())
            cols["n_added"] = pa.array([len(more) for _, more in out], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(label, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")
