"""Media columns: mono 8-bit FLAC streams, encoded and decoded in numpy.

Frames are coded side by side: one numpy step handles the same sample of
thousands of frames.  The decoder follows a stream's seek table, so a long
stream is many lanes, reads Rice residuals, restores fixed and linear
predictors, and verifies the check sums of frame headers and frames and the MD5
of the whole.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbatch.llm.textio import slices

BLOCK = 192  # samples to a frame; block size code 1 of the format
SEEK_EVERY = 4  # frames between seek points
RATE = 8000
_LPC_ORDER, _LPC_BITS, _LPC_SHIFT = 4, 12, 9
#: Coefficients of the fixed predictors of order 0 to 4.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, out = 1 << (bits - 1), []
    for c in range(256):
        c <<= bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & (1 << bits) - 1
        out.append(c)
    return np.array(out, np.uint16 if bits == 16 else np.uint8)


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crcs(table: np.ndarray, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Check sum of each run of bytes in buffer."""
    crc = np.zeros(len(starts), table.dtype)
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
    out = np.zeros(len(starts), table.dtype)
    for t, m in enumerate(active):
        byte = buffer[at[:m] + t]
        c = crc[:m]
        crc[:m] = table[c ^ byte] if table.dtype == np.uint8 else table[(c >> 8).astype(np.uint8) ^ byte] ^ (c << 8)
    out[order] = crc
    return out


def _zigzag(r: np.ndarray) -> np.ndarray:
    return ((r << 1) ^ (r >> 31)).astype(np.int32)


def _lpc(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients per frame, from integer autocorrelations by the Levinson recursion."""
    y = x.astype(np.int64)
    r = np.stack([(y[:, lag:] * y[:, : x.shape[1] - lag]).sum(axis=1) for lag in range(_LPC_ORDER + 1)]).astype(np.float64)
    error = np.maximum(r[0] * 1.0001, 1.0)
    a = np.zeros((_LPC_ORDER, len(x)))
    for i in range(_LPC_ORDER):
        acc = r[i + 1].copy()
        for j in range(i):
            acc -= a[j] * r[i - j]
        k = acc / error
        new = a.copy()
        new[i] = k
        for j in range(i):
            new[j] = a[j] - k * a[i - 1 - j]
        a, error = new, np.maximum(error * (1 - k * k), 1.0)
    top = 1 << (_LPC_BITS - 1)
    return np.clip(np.rint(a * (1 << _LPC_SHIFT)), -top, top - 1).astype(np.int32).T


def _rice(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zigzag values, parameter and bits of each frame's residuals."""
    z = _zigzag(r)
    mean = z.sum(axis=1, dtype=np.int64) * 0.6931 / z.shape[1]
    k = np.maximum(np.frexp(mean)[1], 0)
    k = np.maximum(k, np.frexp(z.max(axis=1).astype(np.float64))[1] - 4)  # quotients stay under 16
    k = np.clip(k, 0, 14).astype(np.int32)
    return z, k, (z >> k[:, None]).sum(axis=1, dtype=np.int64) + z.shape[1] * (1 + k)


def _put(bits: np.ndarray, at: int, values: np.ndarray, width: int) -> int:
    """Write one value of width bits per row at column at."""
    for j in range(width):
        bits[:, at + j] = values >> (width - 1 - j) & 1
    return at + width


def _headers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame headers without check sum, as rows of bytes, and their lengths."""
    out = np.zeros((len(numbers), 12), np.uint8)
    out[:, :4] = (0xFF, 0xF8, 0x10, 0x02)
    size = np.full(len(numbers), 5)
    small = numbers < 0x80
    out[small, 4] = numbers[small]
    for more, low, high, lead in ((1, 7, 11, 0xC0), (2, 11, 16, 0xE0), (3, 16, 21, 0xF0), (4, 21, 26, 0xF8), (5, 26, 31, 0xFC), (6, 31, 36, 0xFE)):
        own = (numbers >= 1 << low) & (numbers < 1 << high)
        if own.any():
            out[own, 4] = lead | (numbers[own] >> 6 * more)
            for j in range(more):
                out[own, 5 + j] = 0x80 | (numbers[own] >> 6 * (more - 1 - j) & 0x3F)
            size[own] = 5 + more
    return out, size


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x: (frames, 192) samples.  The frames' bytes one after another, and their sizes."""
    n = len(x)
    x = x.astype(np.int32)
    best = np.full(n, BLOCK * 8 + 8, np.int64)  # verbatim
    choice = np.full(n, -2)
    diffs = [x]
    for _ in range(4):
        diffs.append(np.diff(diffs[-1], axis=1))
    coef = _lpc(x)
    predicted = np.zeros((n, BLOCK - _LPC_ORDER), np.int32)
    for j in range(_LPC_ORDER):
        predicted += coef[:, j, None] * x[:, _LPC_ORDER - 1 - j : BLOCK - 1 - j]
    coded = [_rice(d) for d in diffs] + [_rice(x[:, _LPC_ORDER:] - (predicted >> _LPC_SHIFT))]
    for c, (_, _, bits) in enumerate(coded):
        order = min(c, 4)
        whole = bits + 8 + 8 * order + 10 + (9 + _LPC_BITS * order if c == 5 else 0)
        better = whole < best
        best[better], choice[better] = whole[better], c
    same = (x == x[:, :1]).all(axis=1)
    best[same], choice[same] = 16, -1
    width = -(-int(best.max()) // 8)
    body = np.zeros((n, width), np.uint8)
    for c in np.unique(choice).tolist():
        own = np.flatnonzero(choice == c)
        if c < 0:
            body[own, 0] = 0 if c == -1 else 2
            body[own, 1 : 2 if c == -1 else BLOCK + 1] = (x[own, : 1 if c == -1 else BLOCK]).astype(np.int8).view(np.uint8)
            continue
        order = min(c, 4)
        bits = np.zeros((len(own), width * 8), np.uint8)
        at = _put(bits, 0, np.full(len(own), 2 * (8 + c if c < 5 else 31 + order)), 8)
        for j in range(order):
            at = _put(bits, at, x[own, j], 8)
        if c == 5:
            at = _put(bits, at, np.full(len(own), (_LPC_BITS - 1) << 5 | _LPC_SHIFT), 9)
            for j in range(order):
                at = _put(bits, at, coef[own, j], _LPC_BITS)
        z, k = coded[c][0][own], coded[c][1][own]
        at = _put(bits, at, k, 10)
        q = z >> k[:, None]
        size = q + 1 + k[:, None]
        stop = np.cumsum(size, axis=1) - size + at + q + (np.arange(len(own)) * width * 8)[:, None]
        flat = bits.reshape(-1)
        flat[stop.ravel()] = 1
        for j in range(int(k.max())):
            some = k > j
            flat[(stop[some] + (k[some] - j)[:, None]).ravel()] = (z[some] >> j & 1).ravel()
        body[own] = np.packbits(bits, axis=1)
    head, head_size = _headers(numbers)
    body_size = -(-best // 8)
    rows = np.zeros((n, 12 + width + 3), np.uint8)
    for h in np.unique(head_size).tolist():
        own = np.flatnonzero(head_size == h)
        rows[own, :h] = head[own, :h]
        rows[own, h + 1 : h + 1 + width] = body[own]
    flat, base = rows.reshape(-1), np.arange(n) * rows.shape[1]
    flat[base + head_size] = _crcs(_CRC8, flat, base, head_size)
    whole = head_size + 1 + body_size
    crc = _crcs(_CRC16, flat, base, whole)
    flat[base + whole], flat[base + whole + 1] = crc >> 8, crc & 0xFF
    sizes = whole + 2
    return flat[np.repeat(base - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())], sizes


def encode_streams(payloads: list[bytes], chunk: int = 4096) -> list[bytes]:
    """FLAC streams of payloads, whose lengths are positive multiples of 192; a byte b is the sample b - 128."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    whole = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    first = np.concatenate([[0], np.cumsum(counts)])
    numbers = np.arange(len(whole)) - np.repeat(first[:-1], counts)
    data, sizes = [], []
    for at in range(0, len(whole), chunk):
        d, s = encode_frames(whole[at : at + chunk].astype(np.int32) - 128, numbers[at : at + chunk])
        data.append(d)
        sizes.append(s)
    data, sizes = np.concatenate(data).tobytes(), np.concatenate(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i, p in enumerate(payloads):
        a, b = first[i], first[i + 1]
        own = sizes[a:b]
        pcm = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        seek = b"".join(struct.pack(">QQH", BLOCK * k, int(ends[a + k] - ends[a]), BLOCK) for k in range(0, int(b - a), SEEK_EVERY))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data[ends[a] : ends[b]])
    return out


def _bits(words: np.ndarray, at: np.ndarray, width) -> np.ndarray:
    """width (1 to 32) bits from bit place at."""
    w = words[at >> 3] << (at & 7).astype(np.uint64)
    return (w >> (np.uint64(64) - np.asarray(width, np.uint64))).astype(np.int64)


def _signed(v: np.ndarray, width) -> np.ndarray:
    half = np.int64(1) << np.asarray(width - 1, np.int64)
    return (v ^ half) - half


def _windows(buffer: np.ndarray) -> np.ndarray:
    """For each byte place, the 64 bits from there on."""
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    out = np.zeros(len(buffer), np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | padded[j : j + len(buffer)]
    return out


def _frame(buffer: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decode the frame at each byte place: samples (lanes, 192), and the place after the frame."""
    head = words[at]
    if ((head >> np.uint64(32)) != np.uint64(0xFFF81002)).any():
        raise ValueError("not a frame of 192 mono 8-bit samples")
    lead = buffer[at + 4]
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    size = 5 + more
    if (_crcs(_CRC8, buffer, at, size) != buffer[at + size]).any():
        raise ValueError("a frame header's check sum is wrong")
    place = at + size + 1
    kind = buffer[place] >> 1
    bit = (place.astype(np.int64) + 1) * 8
    if (buffer[place] & 0x81).any():
        raise ValueError("wasted bits aren't used in these streams")
    n = len(at)
    out = np.zeros((BLOCK, n), np.int32)
    flat = kind == 0
    raw = kind == 1
    if flat.any():
        out[:, flat] = buffer[place[flat] + 1].view(np.int8)
        bit[flat] += 8
    if raw.any():
        out[:, raw] = buffer[(place[raw] + 1)[None, :] + np.arange(BLOCK)[:, None]].view(np.int8)
        bit[raw] += 8 * BLOCK
    for o in np.unique(kind[kind > 1]).tolist():
        own = np.flatnonzero(kind == o)
        if not (8 <= o <= 12 or o >= 32):
            raise ValueError(f"subframe type {o} isn't defined")
        order = o - 8 if o < 32 else o - 31
        b = bit[own]
        x = np.zeros((BLOCK, len(own)), np.int32)
        for j in range(order):
            x[j] = _signed(_bits(words, b, 8), 8)
            b = b + 8
        shift = np.zeros(len(own), np.int64)
        coef = [np.full(len(own), c, np.int64) for c in (FIXED[order] if o < 32 else ())]
        if o >= 32:
            precision = _bits(words, b, 4) + 1
            shift = _signed(_bits(words, b + 4, 5), 5)
            b = b + 9
            for _ in range(order):
                coef.append(_signed(_bits(words, b, precision), precision))
                b = b + precision
        method = _bits(words, b, 2)
        if method.any():
            raise ValueError("only residuals with 4-bit parameters are read")
        step = BLOCK >> _bits(words, b + 2, 4)
        b = b + 6
        due = np.full(len(own), order)
        k = np.zeros(len(own), np.int64)
        one, top = np.uint64(1), np.uint64(64)
        for t in range(order, BLOCK):
            new = due == t
            if new.any():
                k = np.where(new, _bits(words, b, 4), k)
                b = np.where(new, b + 4, b)
                due = np.where(new, (t // step + 1) * step, due)
                if (k == 15).any():
                    raise ValueError("raw partitions aren't used in these streams")
                back, low = top - k.astype(np.uint64), k.astype(np.uint64)
                low = np.where(k == 0, np.uint64(0), low)
            w = words[b >> 3] << (b & 7).astype(np.uint64)
            q = 32 - np.frexp((w >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
            if (q == 32).any():
                q, w = _long_unary(words, b, q, w)
            rest = (w << (np.minimum(q, 32).astype(np.uint64) + one)) >> np.minimum(back, np.uint64(63))
            z = (q << k) | np.where(k > 0, rest.astype(np.int64), 0)
            b = b + q + 1 + k
            predicted = np.zeros(len(own), np.int64)
            for j, c in enumerate(coef):
                predicted += c * x[t - 1 - j]
            x[t] = ((z >> 1) ^ -(z & 1)) + (predicted >> shift)
        out[:, own] = x
        bit[own] = b
    end = (bit + 7) >> 3
    crc = _crcs(_CRC16, buffer, at, end - at)
    if (crc != (buffer[end].astype(np.uint16) << 8 | buffer[end + 1])).any():
        raise ValueError("a frame's check sum is wrong")
    return out.T, end + 2


def _long_unary(words: np.ndarray, b: np.ndarray, q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quotients of 32 and more; w moved so that q + 1 places on, within 33, the low bits begin."""
    q, w = q.copy(), w.copy()
    for i in np.flatnonzero(q == 32):
        at, n = int(b[i]), 0
        while not int(words[at >> 3]) << (at & 7) & 1 << 63:
            at, n = at + 1, n + 1
        q[i] = n
        v = int(words[(at + 1) >> 3]) << ((at + 1) & 7) & (1 << 64) - 1
        w[i] = v >> 33  # the caller shifts by 33 for any q of 32 and more
        if n == 32:
            w[i] = v >> 33
    return q, w


def decode_streams(streams: list[bytes], chunk: int = 8192) -> list[bytes]:
    """The payloads behind encode_streams, with all check sums verified."""
    buffer = np.frombuffer(b"".join(streams) + b"\0" * 16, np.uint8)
    words = _windows(buffer)
    at, lanes, frames, base, infos = 0, [], [], 0, []
    for s in streams:
        if s[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        place, last, info, seek = 4, False, b"", b""
        while not last:
            last, kind, size = bool(s[place] & 0x80), s[place] & 0x7F, int.from_bytes(s[place + 1 : place + 4], "big")
            body = s[place + 4 : place + 4 + size]
            info, seek = body if kind == 0 else info, body if kind == 3 else seek
            place += 4 + size
        samples = int.from_bytes(info[10:18], "big") & (1 << 36) - 1
        count = samples // BLOCK
        points = [p for p in struct.iter_unpack(">QQH", seek) if p[0] != 2**64 - 1] or [(0, 0, BLOCK)]
        edges = [p[0] // BLOCK for p in points] + [count]
        lanes += [at + place + p[1] for p in points]
        frames += [(base + a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        infos.append((samples, info[18:34]))
        at, base = at + len(s), base + count
    out = np.zeros((base, BLOCK), np.int8)
    start, number = np.array(lanes, np.int64), np.array(frames, np.int64).reshape(-1, 2)
    for a in range(0, len(start), chunk):
        place, (first, left) = start[a : a + chunk], number[a : a + chunk].T
        for k in range(int(left.max())):
            own = left > k
            samples, place[own] = _frame(buffer, words, place[own])
            out[first[own] + k] = samples
    raw, payloads, place = out.view(np.uint8), [], 0
    for samples, digest in infos:
        own = raw[place : place + samples // BLOCK].reshape(-1)
        if hashlib.md5(own.tobytes()).digest() != digest:
            raise ValueError("a stream's MD5 is wrong")
        payloads.append((own ^ 0x80).tobytes())
        place += samples // BLOCK
    return payloads


def features(payload: bytes) -> str:
    """Loudness and shape of the samples, in whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    step = np.abs(np.diff(x))
    turns = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"samples={len(x)};peak={int(np.abs(x).max())};mean={int(x.sum()) * 1000 // len(x)};energy={int((x * x).sum()) // len(x)};step={int(step.sum()) * 1000 // len(x)};crossings={turns}"


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and its payload: bytes 32 appended up to a positive multiple of 192."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(-(-len(raw) // BLOCK), 1) * BLOCK - len(raw))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 2 << 20):
        sizes, payloads = zip(*map(padded, b.column("text").to_pylist()), strict=True)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(encode_streams(list(payloads)), pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """documents to rows (doc_id, n_bytes, media): each whole text as a FLAC stream.

    Null texts are empty; one frame of blanks stands for an empty text.  Repeated
    rows stay; equal texts give equal streams; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


BLOCKS = "array<struct<sample_offset long, n_samples int, pcm binary>>"


def _pcm(samples_per_block: int):
    kind = pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media", 2 << 20):
            media = b.column("media").to_pylist()
            starts, at, blocks = [0], [], []
            for payload in decode_streams(media):
                own = range(0, len(payload), samples_per_block)
                at += own
                blocks += [payload[a : a + samples_per_block] for a in own]
                starts.append(len(at))
            cut = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(map(len, blocks), pa.int32()), pa.array(blocks, pa.binary())], fields=list(kind))
            columns = [b.column("doc_id"), b.column("n_bytes"), pa.array(map(len, media), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), cut)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    return run


def decoded(media: DataFrame, samples_per_block: int = 4096) -> DataFrame:
    """Rows (doc_id, n_bytes, media_bytes, media_sha256, blocks): each stream decoded, as PCM blocks in order of their sample offsets."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_pcm(samples_per_block), f"doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks {BLOCKS}")


def pcm_blocks(media: DataFrame, samples_per_block: int = 4096) -> DataFrame:
    """Rows (doc_id, block, sample_offset, n_samples, pcm): unsigned 8-bit samples, any place found by its offset."""
    rows = decoded(media, samples_per_block).select("doc_id", F.posexplode("blocks").alias("block", "_b"))
    return rows.select("doc_id", "block", "_b.sample_offset", "_b.n_samples", "_b.pcm")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            payloads = [b"".join(x["pcm"] for x in blocks) for blocks in b.column("blocks").to_pylist()]
            columns = [pa.array(map(len, payloads), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()), b.column("media_bytes"), b.column("media_sha256"), pa.array(map(features, payloads), pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_digests(media: DataFrame) -> DataFrame:
    """Digests and features of the PCM blocks that decoding a media column gives."""
    return decoded(media).mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
