"""Baseline JPEG columns: bytes kept as DC terms, read back by a marker parser and a Huffman decoder in numpy."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Blocks in a row of an encoded image; a payload is a positive multiple of it.
WIDTH = 64
#: Most rows of blocks in one image: JPEG heights end at 65535 pixels. Longer payloads are several images, one after the other.
MAX_ROWS = 8191
#: Payload bytes that are coded at once.
AT_ONCE = 1 << 20


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


# DC categories 0 to 8 have 4-bit codes 0 to 8; the one AC symbol, end of block, has the code 0 of one bit.
_DHT = _segment(0xC4, bytes([0, 0, 0, 0, 9] + [0] * 12 + list(range(9)))) + _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0]))
_DQT = _segment(0xDB, bytes([0] + [8] + [1] * 63))
_SOS = _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: its bits (category, magnitude, end of block) at the left of 16, and how many."""
    code, size = np.zeros(511, dtype=np.uint16), np.zeros(511, dtype=np.uint8)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        bits = (cat << cat | (d if d > 0 else d + (1 << cat) - 1 if d < 0 else 0)) << 1
        size[d + 255] = 5 + cat
        code[d + 255] = bits << (16 - 5 - cat)
    return code, size


_CODE, _SIZE = _code_table()
_MASK = np.arange(16) < np.arange(17)[:, None]


def _header(rows: int) -> bytes:
    frame = bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * WIDTH).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"\xff\xd8" + _DQT + _segment(0xC0, frame) + _DHT + _segment(0xDD, WIDTH.to_bytes(2, "big")) + _SOS


def _rows_coded(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of each row of samples, without stuffing: a restart interval a row."""
    diff = samples.astype(np.int16)
    diff[:, 1:] -= samples[:, :-1].astype(np.int16)
    diff[:, 0] -= 128
    diff += 255
    code, size = _CODE[diff], _SIZE[diff]
    total = size.sum(axis=1, dtype=np.int64)
    pad = (-total) % 8
    code = np.concatenate([code, np.full((len(code), 1), 0xFFFF, dtype=np.uint16)], axis=1)
    size = np.concatenate([size, pad[:, None].astype(np.uint8)], axis=1)
    bits = np.unpackbits(code.astype(">u2").view(np.uint8).reshape(len(code), -1), axis=1)
    packed = np.packbits(bits.reshape(-1, 16)[_MASK[size.ravel()]]).tobytes()
    ends = np.cumsum((total + pad) // 8).tolist()
    return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG (or several, one after the other) for each payload, whose length is a positive multiple of WIDTH.

    Sample b is the luminance of an 8 x 8 block: with a DC step of 8 its DC term is b - 128, exactly.
    """
    rows = [len(p) // WIDTH for p in payloads]
    coded: list[bytes] = []
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, WIDTH)
    for i in range(0, len(data), AT_ONCE // WIDTH):
        coded += _rows_coded(data[i : i + AT_ONCE // WIDTH])
    out, at = [], 0
    for n in rows:
        image = []
        for start in range(at, at + n, MAX_ROWS):
            some = coded[start : min(start + MAX_ROWS, at + n)]
            image.append(_header(len(some)))
            for k, row in enumerate(some):
                image.append(row.replace(b"\xff", b"\xff\x00"))
                if k + 1 < len(some):
                    image.append(bytes((0xFF, 0xD0 + k % 8)))
            image.append(b"\xff\xd9")
        out.append(b"".join(image))
        at += n
    return out


class Picture:
    """What the markers of one JPEG say, and its scan's restart intervals without stuffing."""

    __slots__ = ("width", "height", "layout", "steps", "tables", "interval", "parts", "n_mcu", "size")


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: code length << 8 | symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, dtype=np.int32)
    code = at = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            lo = code << (16 - length)
            table[lo : lo + (1 << (16 - length))] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


_TABLES: dict[bytes, np.ndarray] = {}
_WHOLE_BLOCKS: dict[tuple[int, int], tuple] = {}


def _whole_blocks(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """By the next 16 bits: (difference << 8) + length of a block that is a DC term and the end of block; 0 where 16 bits don't hold one."""
    key = id(dc), id(ac)
    if key not in _WHOLE_BLOCKS:
        if len(_WHOLE_BLOCKS) > 16:
            _WHOLE_BLOCKS.clear()
        window = np.arange(1 << 16, dtype=np.int64)
        length, cat = dc >> 8, dc & 15
        value = (window << length & 0xFFFF) >> (16 - cat)
        value = np.where((cat > 0) & (value < (1 << np.maximum(cat, 1) - 1)), value - (1 << cat) + 1, value)
        used = length + cat
        last = ac[window << np.minimum(used, 16) & 0xFFFF]
        used = used + (last >> 8)
        fits = (dc > 0) & (last > 0) & (last & 255 == 0) & (used <= 16)
        _WHOLE_BLOCKS[key] = np.where(fits, (value << 8) + used, 0), dc, ac
    return _WHOLE_BLOCKS[key][0]


def _dc_only(words: np.ndarray, bit: np.ndarray, left: np.ndarray, table: np.ndarray) -> np.ndarray | None:
    """The terms of all intervals, one after the other, if each block is a DC term and an end of block; else None."""
    bit, most = bit.copy(), int(left.max(initial=0))
    diff = np.zeros((most, len(left)), dtype=np.int32)
    live, every = np.arange(len(left)), int(left.min(initial=0))
    for k in range(most):
        if k < every:
            at = bit
        else:
            live = np.flatnonzero(left > k)
            at = bit[live]
        entry = table[(words[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(16)]
        if not entry.all():
            return None
        if k < every:
            diff[k] = entry >> 8
            bit += entry & 255
        else:
            diff[k, live] = entry >> 8
            bit[live] = at + (entry & 255)
    terms = diff.cumsum(axis=0).T
    return terms.ravel() if most == every else terms[np.arange(most) < left[:, None]]


def parse(data: bytes, at: int = 0) -> tuple[Picture, int]:
    """(picture, where it ends) of the baseline JPEG at ``at``; raises ValueError on anything else."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    pic, quant, huff, comps = Picture(), {}, {}, []
    pic.interval, at = 0, at + 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                quant[name] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC0:
            pic.height, pic.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                own = body[k + 1 : k + 17 + n]
                if own not in _TABLES:
                    if len(_TABLES) > 64:
                        _TABLES.clear()
                    _TABLES[own] = _lookup(own[:16], own[16:])
                huff[body[k]] = _TABLES[own]
                k += 17 + n
        elif marker == 0xDD:
            pic.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            picked = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    hmax, vmax = max(c[1] for c in comps), max(c[2] for c in comps)
    if len(comps) == 1:
        comps, hmax, vmax = [(comps[0][0], 1, 1, comps[0][3])], 1, 1
    pic.layout = [(i, y, x) for i, c in enumerate(comps) for y in range(c[2]) for x in range(c[1])]
    pic.tables = [(huff[picked[c[0]] >> 4], huff[0x10 | picked[c[0]] & 15]) for c in comps]
    pic.steps = [quant[c[3]] for c in comps]
    across, down = -(-pic.width // (8 * hmax)), -(-pic.height // (8 * vmax))
    pic.n_mcu, pic.size = across * down, (down * comps[0][2], across * comps[0][1], across, down)
    end = at
    while True:  # the first marker that is neither stuffing nor a restart ends the scan
        end = data.index(b"\xff", end)
        if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
            end += 2
            continue
        break
    scan, pic.parts, start = data[at:end], [], 0
    if pic.interval:
        raw = np.frombuffer(scan, dtype=np.uint8)
        marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)).tolist() if len(raw) > 1 else []
        for m in [*marks, len(scan)]:
            pic.parts.append(scan[start:m].replace(b"\xff\x00", b"\xff"))
            start = m + 2
    else:
        pic.parts.append(scan.replace(b"\xff\x00", b"\xff"))
    if data[end + 1] != 0xD9:
        raise ValueError("more than one scan")
    return pic, end + 2


def dc_terms(pics: list[Picture]) -> list[np.ndarray]:
    """The luminance DC terms of each picture in scan order, dequantised.

    All restart intervals of all pictures that share tables and layout are decoded abreast, a symbol a step:
    each has its own bit position, block and coefficient. AC symbols are read past, not kept.
    """
    out: list[np.ndarray | None] = [None] * len(pics)
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(pics):
        groups.setdefault((tuple(p.layout), tuple(id(t) for pair in p.tables for t in pair)), []).append(i)
    for members in groups.values():
        first = pics[members[0]]
        per = len(first.layout)
        luma = [k for k, (c, _, _) in enumerate(first.layout) if c == 0]
        parts, blocks = [], []
        for i in members:
            p = pics[i]
            step = p.interval or p.n_mcu
            want = [min(step, p.n_mcu - k) for k in range(0, p.n_mcu, step)]
            if len(want) != len(p.parts):
                raise ValueError("restart intervals are missing")
            parts += p.parts
            blocks += [w * per for w in want]
        data = np.frombuffer(b"".join([*parts, b"\xff" * 64]), dtype=np.uint8)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        bit = (np.cumsum(sizes) - sizes) * 8
        left = np.array(blocks, dtype=np.int64)
        begin = np.cumsum(left) - left
        found = np.zeros(int(left.sum()), dtype=np.int32)
        words = np.zeros(len(data) - 4, dtype=np.uint32)
        for k in range(4):
            words = words << np.uint32(8) | data[k : len(data) - 4 + k]
        comp_of = np.array([c for c, _, _ in first.layout], dtype=np.int64)
        dc = np.stack([t[0] for t in first.tables])
        ac = np.stack([t[1] for t in first.tables])
        one = len(first.tables) == 1
        pred = np.zeros((len(parts), len(first.tables)), dtype=np.int64)
        quick = _dc_only(words, bit, left, _whole_blocks(*first.tables[0])) if one and per == 1 else None
        if quick is not None:
            found = quick
        live = np.flatnonzero(left > 0) if quick is None else np.zeros(0, dtype=np.int64)
        place = np.zeros(len(parts), dtype=np.int64)  # block of the interval
        coef = np.zeros(len(live), dtype=np.int64)
        while len(live):
            at = bit[live]
            window = words[np.minimum(at >> 3, len(words) - 1)] << (at & 7).astype(np.uint32)
            top = window >> np.uint32(16)
            comp = 0 if one else comp_of[place[live] % per]
            is_dc = coef == 0
            entry = np.where(is_dc, dc[comp, top], ac[comp, top])
            if not entry.all():
                raise ValueError("no such code")
            length, symbol = entry >> 8, entry & 255
            n = symbol & 15
            # 25 bits of the window are sure; a code and its magnitude can need more, so read the magnitude anew.
            at = at + length
            window = words[np.minimum(at >> 3, len(words) - 1)] << (at & 7).astype(np.uint32)
            if is_dc.any():
                k = np.flatnonzero(is_dc)
                size = n[k].astype(np.uint32)
                value = np.where(size > 0, window[k] >> (np.uint32(32) - np.maximum(size, 1)), 0).astype(np.int64)
                value = np.where((size > 0) & (value < (np.int64(1) << np.maximum(size, 1).astype(np.int64) - 1)), value - (np.int64(1) << size.astype(np.int64)) + 1, value)
                own = live[k]
                c = 0 if one else comp[k]
                pred[own, c] += value
                found[begin[own] + place[own]] = pred[own, c]
            run = symbol >> 4
            end = ~is_dc & (n == 0) & (run != 15)
            coef = np.where(is_dc, 1, np.where(end, 64, coef + np.where(is_dc, 0, run + 1)))
            bit[live] = at + n
            full = coef >= 64
            if full.any():
                own = live[full]
                place[own] += 1
                coef[full] = 0
                more = place[live] < left[live]
                if not more.all():
                    live, coef = live[more], coef[more]
        at = 0
        for i in members:
            p = pics[i]
            n = p.n_mcu * per
            own = found[at : at + n].reshape(p.n_mcu, per)[:, luma] * p.steps[0]
            at += n
            ys, xs = p.size[0] // p.size[3], p.size[1] // p.size[2]
            out[i] = own.reshape(p.size[3], p.size[2], ys, xs).transpose(0, 2, 1, 3).reshape(p.size[0], p.size[1])
    return out


def thumbnails(images: list[bytes]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail (a pixel a block) of each value; images that follow one another stand one below the other."""
    pics, owner = [], []
    for i, data in enumerate(images):
        at = 0
        while at < len(data):
            pic, at = parse(data, at)
            pics.append(pic)
            owner.append(i)
    parts: list[list[np.ndarray]] = [[] for _ in images]
    for i, pic, terms in zip(owner, pics, dc_terms(pics), strict=True):
        parts[i].append(np.clip((terms + 4) // 8 + 128, 0, 255).astype(np.uint8)[: -(-pic.height // 8), : -(-pic.width // 8)])
    return [p[0] if len(p) == 1 else np.concatenate(p) for p in parts]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits in hexadecimal: of 8 x 8 cells of the thumbnail, which are lighter than their median."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)
    cols = np.linspace(0, thumb.shape[1], 9).astype(int)
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    sums[1:, 1:] = thumb.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    r0, r1 = np.minimum(rows[:-1], thumb.shape[0] - 1), np.maximum(rows[1:], np.minimum(rows[:-1], thumb.shape[0] - 1) + 1)
    c0, c1 = np.minimum(cols[:-1], thumb.shape[1] - 1), np.maximum(cols[1:], np.minimum(cols[:-1], thumb.shape[1] - 1) + 1)
    total = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    mean = total / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    return np.packbits(mean.ravel() > np.median(mean)).tobytes().hex()


def _some(batch: pa.RecordBatch, column: str, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``most`` bytes each."""
    sizes = [len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)] if pa.types.is_binary(batch.schema.field(column).type) else None
    if sizes is None:
        sizes = [len(t) if t else 0 for t in batch.column(column).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of whole ``docs`` (doc_id, text): UTF-8 bytes, padded with zeros to a positive multiple of 64, as JPEG.

    Null text is empty, that is 64 zeros. A row in, a row out.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in _some(big, "text"):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
                media = encode([b + bytes(-len(b) % WIDTH if b else WIDTH) for b in raw])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(b) for b in raw], pa.int64()), "media": pa.array(media, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(write, f"doc_id {kind}, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def _read(media: list[bytes | None]) -> tuple[list[np.ndarray | None], list[str | None]]:
    """(thumbnail or None, error or None) of each value: broken bytes cost their own row and no other."""
    try:
        return thumbnails([_given(m) for m in media]), [None] * len(media)
    except (ValueError, IndexError, KeyError):
        out: list[tuple[np.ndarray | None, str | None]] = []
        for m in media:
            try:
                out.append((None, "no media") if m is None else (thumbnails([m])[0], None))
            except (ValueError, IndexError, KeyError) as e:
                out.append((None, f"{type(e).__name__}: {e}"))
        return [t for t, _ in out], [e for _, e in out]


def _given(value: bytes | None) -> bytes:
    if value is None:
        raise ValueError("no media")
    return value


def features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of ``media`` (doc_id, n_bytes, media).

    The payload is the thumbnail's pixels, read back from the stored bytes. feature holds the image's width
    and height in pixels and the thumbnail's hash. Bytes that are no baseline JPEG, and null media, give nulls
    and an error; error is null for all others.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in _some(big, "media"):
                media = batch.column("media").to_pylist()
                thumbs, errors = _read(media)
                payload = [None if t is None else t.tobytes() for t in thumbs]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n_bytes": batch.column("n_bytes"),
                        "payload_bytes": pa.array([None if p is None else len(p) for p in payload], pa.int64()),
                        "payload_sha256": pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p in payload], pa.string()),
                        "tail_crc32": pa.array([None if p is None else zlib.crc32(p[-64:]) for p in payload], pa.int64()),
                        "media_bytes": pa.array([None if m is None else len(m) for m in media], pa.int64()),
                        "media_sha256": pa.array([None if m is None else hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                        "feature": pa.array([None if t is None else f"{8 * t.shape[1]}x{8 * t.shape[0]}:{thumbnail_hash(t)}" for t in thumbs], pa.string()),
                        "error": pa.array(errors, pa.string()),
                    }
                )

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(read, f"doc_id {kind}, n_bytes long, {FEATURES}")
