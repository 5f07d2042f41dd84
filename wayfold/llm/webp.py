"""Lossless WebP (VP8L): decoder of the whole format and two encoders, in numpy and plain Python.

Bits are read from the lowest of each byte. An image is a row-major array of uint32, alpha in the highest byte, then red,
green and blue.
"""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
#: Order in which the lengths of code-length codes are stored. Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
MOST_SIDE = 1 << 14


class WebpError(ValueError):
    pass


@functools.cache
def near_offsets() -> list[tuple[int, int]]:
    """Offsets (columns left, rows up) of the 120 short distance codes: nearest first, then by columns, left before right."""
    cells = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(cells, key=lambda c: (c[0] ** 2 + c[1] ** 2, abs(c[0]), -c[0]))


# -- bits -------------------------------------------------------------------------------------------------------------


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + bytes(8), 8 * at
        self.end = 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + (n >> 3) + 2], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise WebpError("the data end too early")
        return out


class BitWriter:
    def __init__(self):
        self.value, self.n, self.done = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 4096:
            whole = self.n >> 3
            self.done += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.n &= 7

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.n + 7) >> 3, "little")


# -- prefix codes -----------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=256)
def canonical(lengths: tuple[int, ...] | bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code with its first bit lowest, bits). A single symbol takes no bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {used[0]: (0, 0)}
    code, last, out = 0, 0, {}
    for n, s in sorted((lengths[s], s) for s in used):
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    if used and code != 1 << last:
        raise WebpError("a prefix code isn't complete")
    return out


class PrefixCode:
    """Reads one symbol at a time through a table over as many bits as the longest code has."""

    def __init__(self, lengths: tuple[int, ...] | bytes):
        codes = canonical(lengths)
        if not codes:
            raise WebpError("a prefix code has no symbols")
        self.bits = max(n for _, n in codes.values())
        self.table: list = [None] * (1 << self.bits)
        for s, (code, n) in codes.items():
            self.table[code :: 1 << n] = [(s, n)] * (1 << (self.bits - n))
        self.only = next(iter(codes)) if self.bits == 0 else None

    def read(self, r: BitReader) -> int:
        s, n = self.table[r.peek(self.bits)]
        r.at += n
        return s


@functools.lru_cache(maxsize=256)
def prefix_code(lengths: tuple[int, ...] | bytes) -> PrefixCode:
    return PrefixCode(lengths)


@functools.cache
def _turned(bits: int) -> np.ndarray:
    """Each number of so many bits with their order reversed."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def code_arrays(lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`canonical` in arrays: symbols by length and number, codes and bits."""
    lengths = np.frombuffer(lengths, np.uint8).astype(np.int64) if isinstance(lengths, bytes) else np.asarray(lengths, np.int64)
    used = lengths.nonzero()[0]
    if not len(used):
        raise WebpError("a prefix code has no symbols")
    if len(used) == 1:
        return used, np.zeros(1, np.int64), np.zeros(1, np.int64)
    n = lengths[used]
    order = n.argsort(kind="stable")
    symbols, n = used[order], n[order]
    span = 1 << (n[-1] - n)
    ends = span.cumsum()
    if ends[-1] != 1 << n[-1]:
        raise WebpError("a prefix code isn't complete")
    return symbols, _turned(int(n[-1]))[ends - span], n


def lookup(lengths) -> tuple[np.ndarray, int]:
    """For each window of as many bits as the longest code has, 16 * symbol + bits; and the mask of such a window."""
    symbols, _, n = code_arrays(lengths)
    top = int(n[-1])
    return np.repeat(symbols << 4 | n, 1 << (top - n))[_turned(top)], (1 << top) - 1


def _parse_lengths(r: BitReader, size: int) -> bytes:
    lengths = bytearray(size)
    if r.read(1):
        two = r.read(1)
        first = r.read(8 if r.read(1) else 1)
        for s in [first, r.read(8)] if two else [first]:
            if s >= size:
                raise WebpError("a symbol is outside its alphabet")
            lengths[s] = 1
        return bytes(lengths)
    own = [0] * 19
    for k in range(4 + r.read(4)):
        own[LENGTH_ORDER[k]] = r.read(3)
    table, mask = lookup(own)
    table = table.tolist()
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    at, before, bits = 0, 8, 14 * size + 64
    v, taken = r.peek(bits), 0  # no code is longer than that
    while at < size and left:
        left -= 1
        t = table[v & mask]
        s, n = t >> 4, t & 15
        v >>= n
        taken += n
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        n = (2, 3, 7)[s - 16]
        times = (11 if s == 18 else 3) + (v & ((1 << n) - 1))
        v >>= n
        taken += n
        if at + times > size:
            raise WebpError("a run of code lengths is too long")
        if s == 16:
            lengths[at : at + times] = bytes([before]) * times
        at += times
    r.at += taken
    if r.at > r.end:
        raise WebpError("the data end too early")
    return bytes(lengths)


# -- decoding ---------------------------------------------------------------------------------------------------------


def _value(prefix: int, r: BitReader) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.read(extra) + 1


def _blocks(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _image(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image; `main` ones may have several groups of prefix codes."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise WebpError("the colour cache is too large")
    meta, meta_bits = None, 0
    if main and r.read(1):
        meta_bits = r.read(3) + 2
        meta = ((_image(r, _blocks(width, meta_bits), _blocks(height, meta_bits), False) >> np.uint32(8)) & np.uint32(0xFFFF)).tolist()
    cache_size = 1 << cache_bits if cache_bits else 0
    sizes = (LITERALS + LENGTHS + cache_size, 256, 256, 256, DISTANCES)
    lengths = [[_parse_lengths(r, n) for n in sizes] for _ in range(max(meta) + 1 if meta else 1)]
    total = width * height
    if len(lengths) == 1:
        return _one_group(r, width, total, lengths[0], cache_bits)
    groups = [[prefix_code(x) for x in g] for g in lengths]
    out = [0] * total
    cache = [0] * cache_size
    shift = 32 - cache_bits
    wide, at, cached = _blocks(width, meta_bits) if meta else 0, 0, 0
    green, red, blue, alpha, distance = groups[0]
    while at < total:
        if meta:
            green, red, blue, alpha, distance = groups[meta[(at // width >> meta_bits) * wide + (at % width >> meta_bits)]]
        s = green.read(r)
        if s < LITERALS:
            colour = s << 8 | red.read(r) << 16
            colour |= blue.read(r)
            out[at] = colour | alpha.read(r) << 24
            at += 1
        elif s < LITERALS + LENGTHS:
            n = _value(s - LITERALS, r)
            d = _value(distance.read(r), r)
            if d > 120:
                d -= 120
            else:
                x, y = near_offsets()[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise WebpError("a back-reference leaves the image")
            for k in range(at, at + n):
                out[k] = out[k - d]
            at += n
        else:
            if s - LITERALS - LENGTHS >= cache_size:
                raise WebpError("a cache index is too large")
            while cached < at:
                cache[(out[cached] * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[at] = cache[s - LITERALS - LENGTHS]
            at += 1
    if r.at > r.end:
        raise WebpError("the data end too early")
    return np.array(out, np.uint32)


#: Bits at which codes are looked up at once, and more that one pixel's codes can take.
SPAN, BEYOND = 1 << 14, 128


def _one_group(r: BitReader, width: int, total: int, lengths: list[bytes], cache_bits: int) -> np.ndarray:
    """An image of one group of codes: at every bit of a stretch it is looked up what a pixel that begins there is and where the next one begins, then the pixels that do begin are followed."""
    (green, mg), (red, mr), (blue, mb), (alpha, ma) = map(lookup, lengths[:4])
    distance, md = lookup(lengths[4]) if any(lengths[4]) else (np.zeros(1, np.int64), 0)
    data = np.frombuffer(r.data + bytes(64), np.uint8)
    left, pos, parts = total, r.at, []
    while left > 0:
        if pos > r.end:
            raise WebpError("the data end too early")
        n = min(SPAN, r.end - pos + 1)
        b = data[pos >> 3 : (pos >> 3) + (n + BEYOND + 31 >> 3)].astype(np.int64)
        w = ((b[:-2] | b[1:-1] << 8 | b[2:] << 16)[:, None] >> np.arange(8)).ravel()[pos & 7 :]
        g = green[w[:n] & mg]
        symbol = g >> 4
        after = np.arange(n) + (g & 15)
        x = red[w[after] & mr]
        at = after + (x & 15)
        y = blue[w[at] & mb]
        at += y & 15
        colour = symbol << 8 | x >> 4 << 16 | y >> 4
        if ma:
            z = alpha[w[at] & ma]
            at += z & 15
            colour |= z >> 4 << 24
        else:
            colour |= int(alpha[0]) >> 4 << 24
        special, size, far = np.flatnonzero(symbol >= LITERALS), None, None
        if len(special):
            cached = special[symbol[special] >= LITERALS + LENGTHS]
            at[cached] = after[cached]
            copied = special[symbol[special] < LITERALS + LENGTHS]
            if len(copied):
                size, far = np.ones(n, np.int64), np.zeros(n, np.int64)
                size[copied], q = _values(symbol[copied] - LITERALS, after[copied], w)
                t = distance[w[q] & md]
                far[copied], at[copied] = _values(t >> 4, q + (t & 15), w)
        begin, p, to = [], 0, memoryview(at)
        for _ in range(left):
            begin.append(p)
            p = to[p]
            if p >= n:
                break
        k = np.array(begin, np.int64)
        if size is None:
            left -= len(k)
        else:
            ends = np.cumsum(size[k])
            if ends[-1] >= left:  # what follows the image was read as pixels too
                k = k[: int(np.searchsorted(ends, left)) + 1]
                p = int(at[k[-1]])
            left -= int(ends[len(k) - 1])
        one = np.ones(len(k), np.int64)
        parts.append((symbol[k], colour[k], one if size is None else size[k], one if size is None else far[k]))
        pos += p
    r.at = pos
    if pos > r.end:
        raise WebpError("the data end too early")
    if left:
        raise WebpError("a back-reference leaves the image")
    symbol, colour, size, far = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not (symbol >= LITERALS).any():
        return colour.astype(np.uint32)
    near = np.array([max(1, x + y * width) for x, y in near_offsets()])
    far = np.where(far > 120, far - 120, near[np.minimum(far, 120) - 1])
    if (symbol >= LITERALS + LENGTHS).any():
        return np.array(_with_cache(symbol, colour, size, far, cache_bits), np.uint32)
    out, ends, is_copy = np.zeros(total, np.uint32), np.cumsum(size), symbol >= LITERALS
    out[(ends - 1)[~is_copy]] = colour[~is_copy]
    for end, n, d in zip(ends[is_copy].tolist(), size[is_copy].tolist(), far[is_copy].tolist(), strict=True):
        at = end - n
        if d > at:
            raise WebpError("a back-reference leaves the image")
        out[at:end] = out[at - d : end - d] if d >= n else np.resize(out[at - d : at], n)
    return out


def _values(prefix: np.ndarray, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of prefixes whose further bits begin at `at`, and where these end."""
    extra = np.maximum(0, (prefix - 2) >> 1)
    more = (w[at] & 511 | w[at + 9] << 9) & ((1 << extra) - 1)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + more + 1), at + extra


def _with_cache(symbol: np.ndarray, colour: np.ndarray, size: np.ndarray, far: np.ndarray, bits: int) -> list[int]:
    """The pixels, one after the other, as a cached colour is what the last pixel of its place was."""
    out: list[int] = []
    cache, shift, add = [0] * (1 << bits), 32 - bits, out.append
    first = LITERALS + LENGTHS
    place = ((colour * CACHE_FACTOR & 0xFFFFFFFF) >> shift).tolist()
    for s, c, p, n, d in zip(symbol.tolist(), colour.tolist(), place, size.tolist(), far.tolist(), strict=True):
        if s < LITERALS:
            add(c)
            cache[p] = c
        elif s >= first:
            c = cache[s - first]
            add(c)
            cache[(c * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = c
        else:
            at = len(out)
            if d > at:
                raise WebpError("a back-reference leaves the image")
            for k in range(at - d, at - d + n):
                c = out[k]
                add(c)
                cache[(c * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = c
    return out


def channels(argb: np.ndarray) -> np.ndarray:
    """Columns alpha, red, green, blue."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int32)


def joined(c: np.ndarray) -> np.ndarray:
    u = c.astype(np.uint32) & np.uint32(255)
    return u[..., 0] << np.uint32(24) | u[..., 1] << np.uint32(16) | u[..., 2] << np.uint32(8) | u[..., 3]


def predicted(mode: int, left, top, right, corner) -> list[int]:
    """One pixel's prediction from its neighbours: left, above, above right and above left, each a list of channels."""
    avg = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clip = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return avg(avg(left, right), top)
    if mode == 6:
        return avg(left, corner)
    if mode == 7:
        return avg(left, top)
    if mode == 8:
        return avg(corner, top)
    if mode == 9:
        return avg(top, right)
    if mode == 10:
        return avg(avg(left, corner), avg(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(a - c) for a, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clip(a + t - c) for a, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clip(m + int((m - c) / 2)) for m, c in zip(avg(left, top), corner, strict=True)]
    return [255, 0, 0, 0]


def _predict(px: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray, forward: bool) -> np.ndarray:
    """Adds predictions to residuals, or takes them from pixels (`forward`)."""
    given = channels(px).tolist()
    out: list = [None] * len(given)
    whole = given if forward else out
    wide = _blocks(width, bits)
    mode_of = ((modes >> np.uint32(8)) & np.uint32(15)).tolist()
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if not at:
                p = [255, 0, 0, 0]
            elif not y:
                p = whole[at - 1]
            elif not x:
                p = whole[at - width]
            else:
                p = predicted(mode_of[(y >> bits) * wide + (x >> bits)], whole[at - 1], whole[at - width], whole[at - width + 1], whole[at - width - 1])
            out[at] = [(v - q if forward else v + q) & 255 for v, q in zip(given[at], p, strict=True)]
    return joined(np.array(out))


def _signed(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int32) ^ 128) - 128


def _cross_colour(px: np.ndarray, width: int, height: int, bits: int, elements: np.ndarray, forward: bool) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    e = channels(elements[(y >> bits) * _blocks(width, bits) + (x >> bits)])
    c = channels(px)
    change = lambda t, v: (_signed(t) * _signed(v & 255)) >> 5
    sign = -1 if forward else 1
    red = (c[:, 1] + sign * change(e[:, 3], c[:, 2])) & 255
    c[:, 3] += sign * (change(e[:, 2], c[:, 2]) + change(e[:, 1], c[:, 1] if forward else red))
    c[:, 1] = red
    return joined(c)


def _green(px: np.ndarray, sign: int) -> np.ndarray:
    c = channels(px)
    c[:, [1, 3]] += sign * c[:, [2]]
    return joined(c)


def _palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _unpack(px: np.ndarray, width: int, height: int, colours: np.ndarray) -> np.ndarray:
    bits = _palette_bits(len(colours))
    g = ((px >> np.uint32(8)) & np.uint32(255)).reshape(height, -1)
    if bits:
        each = 8 >> bits
        g = np.stack([(g >> np.uint32(k * each)) & np.uint32((1 << each) - 1) for k in range(1 << bits)], -1).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[g.ravel()]


def chunk_of(data: bytes) -> bytes:
    """The VP8L chunk of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebpError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        if data[at : at + 4] == b"VP8L":
            if at + 8 + size > len(data):
                raise WebpError("the data end too early")
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise WebpError("no lossless image")


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and pixels of a lossless WebP file. Raises WebpError if the file is damaged."""
    chunk = chunk_of(data)
    r = BitReader(chunk)
    if r.read(8) != SIGNATURE:
        raise WebpError("not a lossless image")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise WebpError("unknown version")
    steps, inner, seen = [], width, set()
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise WebpError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            steps.append((kind, inner, bits, _image(r, _blocks(inner, bits), _blocks(height, bits), False)))
        elif kind == PALETTE:
            size = r.read(8) + 1
            colours = joined(np.cumsum(channels(_image(r, size, 1, False)), 0))
            steps.append((kind, inner, 0, colours))
            inner = _blocks(inner, _palette_bits(size))
        else:
            steps.append((kind, inner, 0, None))
    px = _image(r, inner, height, True)
    for kind, wide, bits, own in reversed(steps):
        if kind == PREDICTOR:
            px = _predict(px, wide, height, bits, own, False)
        elif kind == CROSS_COLOUR:
            px = _cross_colour(px, wide, height, bits, own, False)
        elif kind == SUBTRACT_GREEN:
            px = _green(px, 1)
        else:
            px = _unpack(px, wide, height, own)
    return width, height, px


# -- encoding ---------------------------------------------------------------------------------------------------------


def huffman_lengths(weights, most: int = 15) -> tuple[int, ...]:
    """Code lengths of at most `most` bits for the symbols of positive weight."""
    floor = 0.0
    while True:
        heap = [(max(w, floor), s, (s,)) for s, w in enumerate(weights) if w > 0]
        heapq.heapify(heap)
        lengths = [0] * len(weights)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths, default=0) <= most:
            return tuple(lengths)
        floor = max(floor * 2, sum(weights) / 2**most / 4)


def _write_code(w: BitWriter, lengths: tuple[int, ...]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return
    tokens, at = [], 0
    while at < len(lengths):
        run = 1
        while at + run < len(lengths) and lengths[at + run] == lengths[at]:
            run += 1
        if lengths[at] == 0 and run >= 3:
            run = min(run, 138)
            tokens.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
        elif at and lengths[at] and lengths[at] == lengths[at - 1] and run >= 3:
            run = min(run, 6)
            tokens.append((16, run - 3, 2))
        else:
            run = 1
            tokens.append((lengths[at], 0, 0))
        at += run
    counts = [0] * 19
    for t, _, _ in tokens:
        counts[t] += 1
    own = huffman_lengths(counts, 7)
    w.put(0, 1)
    n = max(4, 1 + max(k for k, s in enumerate(LENGTH_ORDER) if own[s]))
    w.put(n - 4, 4)
    for k in range(n):
        w.put(own[LENGTH_ORDER[k]], 3)
    w.put(0, 1)
    codes = canonical(own)
    for t, extra, bits in tokens:
        w.put(*codes[t])
        w.put(extra, bits)


def _prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix, extra value and extra bits of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + ((v >> extra) & 1), v & ((1 << extra) - 1), extra


def _references(px: list[int], width: int, cache_bits: int, references: bool) -> list[tuple]:
    """Tokens ("px", colour), ("ref", length, distance code), ("cache", index), found greedily by runs of four pixels."""
    tokens, seen, cache, at, cached = [], {}, {}, 0, 0
    codes: dict[int, int] = {}
    for k, (x, y) in enumerate(near_offsets()):
        codes.setdefault(max(1, x + y * width), k + 1)
    while at < len(px):
        size = 0
        if references:
            before = seen.get(tuple(px[at : at + 4])) if at + 4 <= len(px) else None
            if before is not None:
                while at + size < len(px) and size < 4096 and px[before + size] == px[at + size]:
                    size += 1
        step = max(1, size)
        if size:
            d = at - before
            tokens.append(("ref", size, codes.get(d, d + 120)))
        else:
            while cache_bits and cached < at:
                cache[(px[cached] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = px[cached]
                cached += 1
            slot = (px[at] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else -1
            tokens.append(("cache", slot) if cache.get(slot) == px[at] else ("px", px[at]))
        for k in range(at, at + step):
            seen[tuple(px[k : k + 4])] = k
        at += step
    return tokens


def _write_image(w: BitWriter, px: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False, meta_bits: int = 0) -> None:
    w.put(bool(cache_bits), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    height = len(px) // width
    groups, meta = 1, None
    if main:
        w.put(bool(meta_bits), 1)
        if meta_bits:
            wide = _blocks(width, meta_bits)
            n = wide * _blocks(height, meta_bits)
            groups = min(n, 3)
            meta = [k % groups for k in range(n)]
            w.put(meta_bits - 2, 3)
            _write_image(w, np.array([m << 8 for m in meta], np.uint32), wide, False)
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    counts = [[[0] * n for n in sizes] for _ in range(groups)]
    tokens, at = [], 0
    for t in _references(px.tolist(), width, cache_bits, references):
        own = counts[meta[(at // width >> meta_bits) * wide + (at % width >> meta_bits)]] if meta else counts[0]
        if t[0] == "px":
            a, r, g, b = (t[1] >> 24) & 255, (t[1] >> 16) & 255, (t[1] >> 8) & 255, t[1] & 255
            parts = [(0, g), (1, r), (2, b), (3, a)]
            extra = []
            step = 1
        elif t[0] == "cache":
            parts, extra, step = [(0, LITERALS + LENGTHS + t[1])], [], 1
        else:
            (p, e, n), (q, f, m) = _prefix_of(t[1]), _prefix_of(t[2])
            parts, extra, step = [(0, LITERALS + p), (4, q)], [(e, n), (f, m)], t[1]
        for k, s in parts:
            own[k][s] += 1
        tokens.append((own, parts, extra))
        at += step
    written = {}
    for own in counts:
        lengths = [huffman_lengths(c) for c in own]
        for n in lengths:
            _write_code(w, n)
        written[id(own)] = [canonical(n) for n in lengths]
    for own, parts, extra in tokens:
        codes = written[id(own)]
        for k, (table, s) in enumerate(parts):
            w.put(*codes[table][s])
            if extra:
                w.put(*extra[k])


def riff(chunk: bytes) -> bytes:
    pad = bytes(len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(chunk) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + pad


def _head(width: int, height: int, alpha: bool) -> BitWriter:
    if not (1 <= width <= MOST_SIDE and 1 <= height <= MOST_SIDE):
        raise WebpError("a side is empty or too long")
    w = BitWriter()
    for v, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        w.put(int(v), n)
    return w


def _palette(w: BitWriter, colours: np.ndarray, index: np.ndarray, width: int, height: int) -> tuple[np.ndarray, int]:
    """Writes the colours; the image of their numbers, several in a pixel where they are few, and its width."""
    c = channels(colours)
    c[1:] -= c[:-1].copy()
    _write_image(w, joined(c), len(colours), False)
    bits = _palette_bits(len(colours))
    inner = _blocks(width, bits)
    grid = np.zeros((height, inner << bits), np.uint32)
    grid[:, :width] = index.reshape(height, width)
    packed = sum(grid[:, k :: 1 << bits] << np.uint32(k * (8 >> bits)) for k in range(1 << bits)) if bits else grid
    return (packed.astype(np.uint32) << np.uint32(8) | np.uint32(255 << 24)).ravel(), inner


def encode(px: np.ndarray, width: int, transforms: tuple[int, ...] = (), cache_bits: int = 0, references: bool = True, meta_bits: int = 0, block_bits: int = 2, seed: int = 0) -> bytes:
    """A lossless file of the pixels with any of the format's tools; predictor modes and colour elements are drawn from `seed`."""
    height = len(px) // width
    w = _head(width, height, bool((px >> np.uint32(24) != 255).any()))
    rng = np.random.default_rng(seed)
    inner = width
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            wide = _blocks(inner, block_bits)
            n = wide * _blocks(height, block_bits)
            own = (rng.integers(0, 14, n) << 8 if kind == PREDICTOR else rng.integers(0, 1 << 24, n)).astype(np.uint32) | np.uint32(255 << 24)
            w.put(block_bits - 2, 3)
            _write_image(w, own, wide, False)
            px = (_predict if kind == PREDICTOR else _cross_colour)(px, inner, height, block_bits, own, True)
        elif kind == SUBTRACT_GREEN:
            px = _green(px, -1)
        else:
            colours, index = np.unique(px, return_inverse=True)
            if len(colours) > 256:
                raise WebpError("too many colours for a palette")
            w.put(len(colours) - 1, 8)
            px, inner = _palette(w, colours, index, inner, height)
    w.put(0, 1)
    _write_image(w, px, inner, True, cache_bits, references, meta_bits)
    return riff(w.bytes())


#: Bits of a code at most in encode_bytes, so that three of them and a shift fit 64.
MOST_BITS = 11
#: Pixels of a back-reference at least and at most.
LEAST_COPY, MOST_COPY = 4, 4096


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """`huffman_lengths` of counts, by two queues."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    while True:
        order = used[np.argsort(counts[used], kind="stable")]
        w, n = counts[order].tolist(), len(order)
        parent, i, j = [0] * (2 * n - 1), 0, n
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if i < n and (j >= k or w[i] <= w[j]):
                    total += w[i]
                    parent[i] = k
                    i += 1
                else:
                    total += w[j]
                    parent[j] = k
                    j += 1
            w.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= most:
            out[order] = depth[:n]
            return out
        counts = (counts + 1) >> 1


def _put_code(w: BitWriter, lengths: np.ndarray) -> None:
    """`_write_code`, run by run."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        _write_code(w, tuple(lengths.tolist()))
        return
    starts = [0, *((lengths[1:] != lengths[:-1]).nonzero()[0] + 1).tolist()]
    tokens = []
    for s, a, b in zip(lengths[starts].tolist(), starts, [*starts[1:], len(lengths)], strict=True):
        run = b - a
        if s:
            tokens.append((s, 0, 0))
            run -= 1
        while run >= 3:
            if s:
                n = min(run, 6)
                tokens.append((16, n - 3, 2))
            else:
                n = min(run, 138)
                tokens.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
            run -= n
        tokens += [(s, 0, 0)] * run
    own = code_lengths(np.bincount([t for t, _, _ in tokens], minlength=19), 7)
    n = max(4, 1 + max(k for k, s in enumerate(LENGTH_ORDER) if own[s]))
    w.put((n - 4) << 1, 5)
    for k in range(n):
        w.put(int(own[LENGTH_ORDER[k]]), 3)
    w.put(0, 1)
    codes = {s: (c, n) for s, c, n in zip(*(x.tolist() for x in code_arrays(own)), strict=True)}
    value = at = 0
    for t, extra, bits in tokens:
        c, n = codes[t]
        value |= (c | extra << n) << at
        at += n + bits
    w.put(value, at)


def _copies(px: np.ndarray) -> list[tuple[int, int, int]]:
    """(at, pixels, pixels back) of the stretches of LEAST_COPY pixels or more that stand before, found greedily: each is compared with where its first four stood last."""
    n = len(px) - LEAST_COPY + 1
    if n < 2:
        return []
    x, times = px.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        key = x[:n]
        for k in range(1, LEAST_COPY):
            key = key * times + x[k : k + n]
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(again):
        return []
    at, before = order[again + 1], order[again]
    place = np.argsort(at)
    out, end = [], 0
    for a, b in zip(at[place].tolist(), before[place].tolist(), strict=True):
        if a < end:
            continue
        here = px[a : a + MOST_COPY]
        other = here != px[b : b + len(here)]
        size = int(other.argmax())
        size = size if other[size] else len(here)
        if size >= LEAST_COPY:
            out.append((a, size, a - b))
            end = a + size
    return out


def _cost(*counts: np.ndarray) -> float:
    """Bits that symbols of these counts take, about, with their codes."""
    total = 0.0
    for c in counts:
        c = c[c > 0]
        total += float((c * np.log2(c.sum() / c)).sum()) + 5 * len(c) if len(c) else 0.0
    return total


def _split(px: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Green, red and blue."""
    return px >> 8 & 255, px >> 16 & 255, px & 255


def _counts(px: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(c, minlength=256) for c in _split(px)]


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_prefix_of` in arrays."""
    v = values - 1
    extra = np.maximum(0, np.frexp(np.maximum(v, 1).astype(float))[1] - 2)
    return np.where(v < 4, v, 2 * (extra + 1) + (v >> extra & 1)), np.where(v < 4, 0, v & ((1 << extra) - 1)), np.where(v < 4, 0, extra)


_OPAQUE = np.zeros(256, np.int64)
_OPAQUE[255] = 1


def _put_image(w: BitWriter, px: np.ndarray, width: int, plain: list[np.ndarray]) -> bytes:
    """The main image after what `w` has: back-references, a colour cache where it makes the image smaller, and prefix codes made for the image. `plain`: the counts of its green, red and blue."""
    copies = _copies(px)
    at, size, back = (np.array(x, np.int64) for x in zip(*copies, strict=True)) if copies else (np.zeros(0, np.int64),) * 3
    single = np.ones(len(px), bool)
    for a, n, _ in copies:
        single[a : a + n] = False
    alone = single.nonzero()[0]
    one = px[alone]
    if copies:
        plain = _counts(one)
    bits = min(9, max(1, len(px).bit_length() - 2))
    place = (px * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - bits)
    order = np.argsort(place.astype(np.uint16), kind="stable")
    hit = np.zeros(len(px), bool)
    hit[order[1:]] = px[order[1:]] == px[order[:-1]]  # equal colours have one place
    hit = hit[alone]
    cached, none = _counts(one[~hit]), np.zeros(LENGTHS, np.int64)
    cached[0] = np.concatenate([cached[0], none, np.bincount(place[alone[hit]], minlength=1 << bits)])
    if _cost(*cached) >= _cost(*plain):
        hit[:] = False
        bits, cached = 0, [np.concatenate([plain[0], none]), *plain[1:]]
    distances = np.zeros(DISTANCES, np.int64)
    if copies:
        far = back + 120
        for k, (x, y) in reversed([*enumerate(near_offsets())]):
            far[back == max(1, x + y * width)] = k + 1
        (p, e, m), (q, f, o) = _prefixes(size), _prefixes(far)
        cached[0][LITERALS : LITERALS + LENGTHS] = np.bincount(p, minlength=LENGTHS)
        distances = np.bincount(q, minlength=DISTANCES)
    lengths = [*map(code_lengths, cached), _OPAQUE, code_lengths(distances)]
    w.put(bits << 1 | 1 if bits else 0, 5 if bits else 1)
    w.put(0, 1)
    for n in lengths:
        _put_code(w, n)
    tables = []
    for n in lengths:
        code, long = np.zeros((2, len(n)), np.int64)
        if n is not _OPAQUE and (copies or n is not lengths[4]):
            symbols, code[symbols], long[symbols] = code_arrays(n)
        tables.append((code, long))
    g, r, b = _split(one)
    (gc, gn), (rc, rn), (bc, bn) = tables[:3]
    long, x = gn[g], rn[r]
    code = gc[g] | rc[r] << long
    long += x
    code |= bc[b] << long
    long += bn[b]
    if bits:
        s = place[alone[hit]] + LITERALS + LENGTHS
        code[hit], long[hit] = gc[s], gn[s]
    if copies:
        p, (dc, dn) = p + LITERALS, tables[4]
        order = np.argsort(np.concatenate([alone, at, at]), kind="stable")
        code = np.concatenate([code, gc[p] | e << gn[p], dc[q] | f << dn[q]])[order]
        long = np.concatenate([long, gn[p] + m, dn[q] + o])[order]
    return _packed(w, code, long)


def _packed(w: BitWriter, code: np.ndarray, long: np.ndarray) -> bytes:
    """What `w` has and then the codes, of at most 33 bits each."""
    lead = 8 * len(w.done) + w.n
    ends = np.cumsum(long) + lead
    start = ends - long
    word, value = start >> 5, code.astype(np.uint64) << (start & 31).astype(np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    words[word[first]] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    words[word[first] + 1] += np.add.reduceat(value >> np.uint64(32), first)
    out = bytearray(words.astype("<u4").tobytes()[: (int(ends[-1]) + 7) >> 3])
    head = w.bytes()
    whole = lead >> 3
    out[:whole] = head[:whole]
    if lead & 7:
        if len(out) == whole:
            out.append(0)
        out[whole] |= head[whole]
    return bytes(out)


def encode_bytes(data: bytes, width: int) -> bytes:
    """A file whose opaque pixels hold `data` as red, green and blue samples, made in numpy.

    Of the format's transforms a palette (up to 256 colours) or the subtraction of green is taken where an estimate of the
    size says so; then come back-references, a colour cache and prefix codes made for the image.
    """
    height = len(data) // (3 * width)
    if 3 * width * height != len(data):
        raise WebpError("the samples don't fill the image")
    w = _head(width, height, False)
    rgb = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
    px = 255 << 24 | rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]
    kind, new, counts = None, px, _counts(px)
    best = _cost(*counts)
    green = rgb[:, 1]
    less = 255 << 24 | (rgb[:, 0] - green & 255) << 16 | green << 8 | rgb[:, 2] - green & 255
    if (cost := _cost(*(own := _counts(less)))) < best:
        kind, new, counts, best = SUBTRACT_GREEN, less, own, cost
    if len(np.unique(px[:384])) <= 256:
        colours, index = np.unique(px, return_inverse=True)
        if len(colours) <= 256 and 24 * len(colours) + _cost(np.bincount(index)) < best:
            kind = PALETTE
    if kind is not None:
        w.put(kind << 1 | 1, 3)
    if kind == PALETTE:
        w.put(len(colours) - 1, 8)
        new, inner = _palette(w, colours, index, width, height)
        w.put(0, 1)
        new = new.astype(np.int64)
        return riff(_put_image(w, new, inner, _counts(new)))
    w.put(0, 1)
    return riff(_put_image(w, new, width, counts))
