"""Lossless WebP (VP8L, RFC 9649): a complete decoder to pixel arrays, and an encoder to write media columns.

The decoder reads the container, prefix codes (simple and normal), back-references with the distance map, the colour cache and
entropy images, and inverts the predictor, cross-colour, subtract-green and palette transforms.  Runs of green literals, which is what
an image of 8-bit samples is made of, are decoded some thousand bits at a time: the code that would begin at *every* bit is looked up with
numpy, and the stream then is a walk along those lengths.

The encoder writes any of these features on request (the decoder's tests use all of them); for 8-bit samples it takes a palette, one
prefix code, and back-references to repeated lines."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import bounded_batches

# -- fixed values of the format
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
LENGTH_CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTHS, DISTANCES = 24, 40
CACHE_MULTIPLIER = 0x1E35A7BD
MAX_SIDE = 1 << 14
BLACK = 0xFF000000
#: Near pixels by distance code: x from -7 to 8 and y from 0 to 7 rows up, the nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))

#: Bits whose codes are looked up at once; shortest line that is worth a back-reference.
SEGMENT = 1 << 18
MIN_MATCH = 12
MAX_MATCH = 4096
#: Longest code that the encoder gives samples: short decoding tables at a few thousandths of the size.
SHORT_CODES = 12


# -- bits
class Reader:
    def __init__(self, data: bytes):
        self.data, self.pos = data + b"\0" * 16, 0
        self.end = 8 * len(data)

    def read(self, n: int) -> int:
        at = self.pos >> 3
        v = int.from_bytes(self.data[at : at + 5], "little") >> (self.pos & 7) & ((1 << n) - 1)
        self.pos += n
        if self.pos > self.end:
            raise ValueError("the stream ends early")
        return v

    def symbol(self, code: Prefix) -> int:
        if not code.bits:
            return code.only
        at = self.pos >> 3
        v = int.from_bytes(self.data[at : at + 3], "little") >> (self.pos & 7) & ((1 << code.bits) - 1)
        found = int(code.table[v])
        self.pos += found & 15
        if self.pos > self.end:
            raise ValueError("the stream ends early")
        return found >> 4


class Writer:
    """Bits as pairs of value and width, packed at the end."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.widths: list[int] = []

    def write(self, value: int, width: int) -> None:
        self.values.append(value)
        self.widths.append(width)

    def _close(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.int64), np.array(self.widths, np.int64)))
            self.values, self.widths = [], []

    def write_all(self, values: np.ndarray, widths: np.ndarray) -> None:
        self._close()
        self.parts.append((values, widths))

    def bytes(self) -> bytes:
        self._close()
        values, widths = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        ends = np.cumsum(widths)
        total = int(ends[-1])
        within = np.arange(total) - np.repeat(ends - widths, widths)
        return np.packbits((np.repeat(values, widths) >> within & 1).astype(np.uint8), bitorder="little").tobytes()


# -- prefix codes
def _reversed16() -> np.ndarray:
    out = np.arange(1 << 16)
    for width in (1, 2, 4, 8):  # swap ever larger neighbours
        low = np.int64(((1 << 16) - 1) // ((1 << width) + 1))
        out = (out >> width & low) | (out & low) << width
    return out


REVERSED = _reversed16()


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in canonical order, their codes as the bits come in the stream, and the codes' sizes."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[used]
    share = np.left_shift(1, 16 - sizes)  # of the code space, in 65536ths
    return used, REVERSED[np.cumsum(share) - share] if len(used) > 1 else np.zeros(len(used), np.int64), sizes


def code_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and sizes by symbol, for writing; a symbol that is alone takes no bits."""
    used, found, sizes = canonical(lengths)
    codes, out = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    codes[used] = found
    if len(used) > 1:
        out[used] = sizes
    return codes, out


class Prefix:
    """A decoding table over the longest code; ``only`` if there is one symbol, which takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used, codes, sizes = canonical(lengths)
        self.bits, self.only = 0, int(used[0]) if len(used) else 0
        if len(used) > 1:
            self.bits = int(sizes[-1])
            if np.left_shift(1, self.bits - sizes).sum() != 1 << self.bits:
                raise ValueError("a prefix code isn't complete")
            self.table = np.empty(1 << self.bits, np.int32)  # symbol and, in the low 4 bits, size of its code
            for entry, c, n in zip((used << 4 | sizes).tolist(), codes.tolist(), sizes.tolist(), strict=True):
                self.table[c :: 1 << n] = entry

    @classmethod
    def single(cls, symbol: int) -> Prefix:
        out = cls.__new__(cls)
        out.bits, out.only = 0, symbol
        return out


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits; a single symbol has length 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, n = {}, len(weights)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = n
            heapq.heapreplace(heap, (a[0] + b[0], n))
            n += 1
        depth = {n - 1: 0}
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[k] for k in range(len(weights))) <= most:
            out[used] = [depth[k] for k in range(len(weights))]
            return out
        weights = [(w >> 1) | 1 for w in weights]  # flatter, until the deepest fits


def write_simple(w: Writer, symbols: list[int]) -> None:
    """One or two symbols below 256."""
    w.write(1, 1), w.write(len(symbols) - 1, 1), w.write(1, 1), w.write(symbols[0], 8)
    if len(symbols) == 2:
        w.write(symbols[1], 8)


def write_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        write_simple(w, used.tolist() or [0])
        return
    tokens, k, end = [], 0, int(used[-1]) + 1
    listed, used = lengths.tolist(), [*used.tolist(), end]
    for at in used:
        while k < at:
            run = min(138, at - k)
            tokens.extend([(18, run - 11, 7)] if run >= 11 else [(17, run - 3, 3)] if run >= 3 else [(0, 0, 0)] * run)
            k += run
        if k < end:
            tokens.append((listed[k], 0, 0))
            k += 1
    counts = np.bincount([t[0] for t in tokens], minlength=19)
    own = code_lengths(counts, 7)
    codes, sizes = (x.tolist() for x in code_table(own))
    listed = [int(own[s]) for s in LENGTH_CODE_ORDER]
    n = max(4, max(k + 1 for k, v in enumerate(listed) if v))
    w.write(0, 1), w.write(n - 4, 4)
    for v in listed[:n]:
        w.write(v, 3)
    bits = max(2, (len(tokens) - 2).bit_length() + 1 & ~1)
    w.write(1, 1), w.write((bits - 2) // 2, 3), w.write(len(tokens) - 2, bits)
    for s, extra, width in tokens:
        w.write(codes[s], sizes[s])
        if width:
            w.write(extra, width)


def read_code(r: Reader, alphabet: int) -> Prefix:
    lengths = np.zeros(alphabet, np.int64)
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        symbols = [r.read(8 if wide else 1)] + ([r.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise ValueError("a symbol outside the alphabet")
        if not two:
            return Prefix.single(symbols[0])
        lengths[symbols] = 1
        return Prefix(lengths)
    own = np.zeros(19, np.int64)
    for s in LENGTH_CODE_ORDER[: 4 + r.read(4)]:
        own[s] = r.read(3)
    code = Prefix(own)
    most = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    k, last = 0, 8
    while k < alphabet and most:
        most -= 1
        s = r.symbol(code)
        if s < 16:
            lengths[k], k = s, k + 1
            last = s or last
        else:
            run = 3 + r.read(2) if s == 16 else 3 + r.read(3) if s == 17 else 11 + r.read(7)
            if k + run > alphabet:
                raise ValueError("code lengths beyond the alphabet")
            lengths[k : k + run] = last if s == 16 else 0
            k += run
    return Prefix(lengths)


def prefix_value(r: Reader, p: int) -> int:
    if p < 4:
        return p + 1
    extra = (p - 2) >> 1
    return ((2 + (p & 1)) << extra) + r.read(extra) + 1


def value_prefix(v: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number, of a length or distance code."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    extra = v.bit_length() - 2
    return 2 * extra + 2 + (v >> extra & 1), v & ((1 << extra) - 1), extra


# -- entropy-coded images
def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels in a flat array."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, tiles, tile_bits, tile_width = 1, None, 0, 0
    if main and r.read(1):
        tile_bits = r.read(3) + 2
        tile_width = -(-width >> tile_bits)
        tiles = (read_image(r, tile_width, -(-height >> tile_bits), False) >> 8 & 0xFFFF).astype(np.int64)
        groups = int(tiles.max()) + 1
    green = 256 + LENGTHS + ((1 << cache_bits) if cache_bits else 0)
    codes = [[read_code(r, n) for n in (green, 256, 256, 256, DISTANCES)] for _ in range(groups)]
    if groups == 1 and not cache_bits and not any(c.bits for c in codes[0][1:4]):
        return _read_samples(r, codes[0], width, width * height)
    out, n, total = np.zeros(width * height, np.uint32), 0, width * height
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    while n < total:
        group = codes[int(tiles[(n // width >> tile_bits) * tile_width + (n % width >> tile_bits)])] if tiles is not None else codes[0]
        s = r.symbol(group[0])
        if s < 256:
            argb = r.symbol(group[1]) << 16 | s << 8
            argb |= r.symbol(group[2])
            argb |= r.symbol(group[3]) << 24
            new = [argb]
        elif s < 256 + LENGTHS:
            length = prefix_value(r, s - 256)
            d = _distance(prefix_value(r, r.symbol(group[4])), width)
            if d > n or n + length > total:
                raise ValueError("a back-reference outside the image")
            new = []
            for k in range(length):
                new.append(int(out[n - d + k]) if k < d else new[k - d])
        else:
            new = [cache[s - 256 - LENGTHS]]
        out[n : n + len(new)] = new
        n += len(new)
        if cache_bits:
            for argb in new:
                cache[(CACHE_MULTIPLIER * argb & 0xFFFFFFFF) >> shift] = argb
    return out


def _read_samples(r: Reader, group: list[Prefix], width: int, total: int) -> np.ndarray:
    """The image where only green varies: literals and back-references."""
    green, rest = group[0], np.uint32(group[3].only << 24 | group[1].only << 16 | group[2].only)
    out, n = np.zeros(total, np.uint8), 0
    if not green.bits and green.only < 256:
        out[:] = green.only
        n = total
    raw, mask = np.frombuffer(r.data, np.uint8), np.int32((1 << green.bits) - 1)
    while n < total:
        first, last = r.pos, min(r.pos + SEGMENT, r.end)
        if last <= first:
            raise ValueError("the stream ends early")
        size = last - first
        part = raw[first >> 3 : (last >> 3) + 3].astype(np.int32)
        words = part[:-2] | part[1:-1] << 8 | part[2:] << 16
        window = ((words[:, None] >> np.arange(8, dtype=np.int32)) & mask).ravel()[first & 7 : (first & 7) + size]
        found = green.table[window] if green.bits else np.full(size, green.only << 4, np.int32)
        # where the walk goes from each bit; other symbols than literals, and the end of what was looked up, keep it where it is
        step = np.arange(size + 1, dtype=np.int32)
        step[:size] += np.where(found < 256 << 4, found & 15, 0)
        np.minimum(step, size, out=step)
        steps = [step]
        for _ in range(3):
            steps.append(steps[-1][steps[-1]])
        leap, p = steps[-1], 0
        while p < size and n < total:
            stops, left = [p], (total - n) // 8 + 2
            while left:
                to = int(leap[p])
                if to == p:
                    break
                stops.append(to)
                p, left = to, left - 1
            walk = np.array(stops, np.int32)[:, None]
            for s in steps[2::-1]:
                walk = np.stack([walk, s[walk]], axis=2).reshape(len(walk), -1)
            walk = walk.ravel()
            literal = (walk < size) & (found[np.minimum(walk, size - 1)] < 256 << 4)
            count = int(literal.argmin()) if not literal.all() else len(literal)
            count = min(count, total - n)
            out[n : n + count] = found[walk[:count]] >> 4
            n += count
            p = int(walk[count - 1] + (found[walk[count - 1]] & 15)) if count else p
            r.pos = first + p
            if n < total and p < size and found[p] >= 256 << 4:
                r.pos += int(found[p]) & 15
                length = prefix_value(r, (int(found[p]) >> 4) - 256)
                d = _distance(prefix_value(r, r.symbol(group[4])), width)
                if d > n or n + length > total:
                    raise ValueError("a back-reference outside the image")
                out[n : n + length] = np.resize(out[n - d : n - d + min(d, length)], length)
                n += length
                p = r.pos - first
    if r.pos > r.end:
        raise ValueError("the stream ends early")
    return out.astype(np.uint32) << 8 | rest


def write_image(w: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, matches: list[tuple[int, int, int]] | None = None, tiles: tuple[int, np.ndarray] | None = None) -> None:
    """``matches``: (at, distance in pixels, length), apart and in order.  ``tiles``: bits, and the group of each tile."""
    w.write(1 if cache_bits else 0, 1)
    if cache_bits:
        w.write(cache_bits, 4)
    groups = 1
    if not cache_bits and not tiles and not ((pixels ^ pixels[0]) & np.uint32(0xFFFF00FF)).any():
        if main:
            w.write(0, 1)
        _write_samples(w, (pixels >> 8 & 0xFF).astype(np.int64), int(pixels[0]), matches or [])
        return
    if main:
        w.write(1 if tiles else 0, 1)
        if tiles:
            w.write(tiles[0] - 2, 3)
            groups = int(tiles[1].max()) + 1
            write_image(w, (tiles[1].ravel().astype(np.uint32) << 8) | np.uint32(BLACK), tiles[1].shape[1], False)
    n = len(pixels)
    kind = np.zeros(n, np.int8)  # 0 literal, 1 start of a match, 2 inside one, 3 from the cache
    green = (pixels >> 8 & 0xFF).astype(np.int64)
    extra: dict[int, tuple] = {}
    for at, d, length in matches or ():
        kind[at], kind[at + 1 : at + length] = 1, 2
        a, b = value_prefix(length), value_prefix(d + len(NEAR))
        green[at] = 256 + a[0]
        extra[at] = (a, b)
    if cache_bits:
        cache = [0] * (1 << cache_bits)
        for k, argb in enumerate(pixels.tolist()):
            slot = (CACHE_MULTIPLIER * argb & 0xFFFFFFFF) >> (32 - cache_bits)
            if kind[k] == 0 and cache[slot] == argb:
                kind[k], green[k] = 3, 256 + LENGTHS + slot
            cache[slot] = argb
    read = np.flatnonzero(kind != 2)
    y, x = read // width, read % width
    group = tiles[1][y >> tiles[0], x >> tiles[0]] if tiles else np.zeros(len(read), np.int64)
    channels = [green[read], *((pixels[read] >> s & 0xFF).astype(np.int64) for s in (16, 0, 24))]
    literal = kind[read] == 0
    sizes = [256 + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCES]
    far = np.array([extra[k][1][0] if kind[k] == 1 else -1 for k in read.tolist()]) if extra else np.full(len(read), -1)
    values, widths = [], []
    tables = []
    for g in range(groups):
        here = group == g
        counted = [np.bincount(channels[0][here], minlength=sizes[0])]
        counted += [np.bincount(c[here & literal], minlength=256) for c in channels[1:]]
        counted.append(np.bincount(far[here & (far >= 0)], minlength=DISTANCES))
        own = []
        for c in counted:
            lengths = code_lengths(c)
            write_code(w, lengths)
            own.append(code_table(lengths))
        tables.append(own)
    for c in range(4):
        v, b = np.zeros(len(read), np.int64), np.zeros(len(read), np.int64)
        for g in range(groups):
            here = (group == g) & (literal if c else True)
            v[here], b[here] = tables[g][c][0][channels[c][here]], tables[g][c][1][channels[c][here]]
        values.append(v), widths.append(b)
    live = [k for k in range(4) if widths[k].any()]
    if not extra:
        if live:
            w.write_all(np.stack([values[k] for k in live], 1).ravel(), np.stack([widths[k] for k in live], 1).ravel())
        return
    begin = 0
    starts = np.flatnonzero(kind[read] == 1).tolist()
    for k in [*starts, len(read)]:
        if k > begin and live:
            w.write_all(np.stack([values[c][begin:k] for c in live], 1).ravel(), np.stack([widths[c][begin:k] for c in live], 1).ravel())
        if k < len(read):
            (_, e1, b1), (s2, e2, b2) = extra[int(read[k])]
            w.write(int(values[0][k]), int(widths[0][k])), w.write(e1, b1)
            codes, lengths = tables[int(group[k])][4]
            w.write(int(codes[s2]), int(lengths[s2])), w.write(e2, b2)
        begin = k + 1


def _write_samples(w: Writer, green: np.ndarray, rest: int, matches: list[tuple[int, int, int]]) -> None:
    """The image where only green varies."""
    inside = np.zeros(len(green) + 1, np.int8)
    coded = []
    for at, d, length in matches:
        inside[at : at + length] = 1
        coded.append((at, at + length, value_prefix(length), value_prefix(d + len(NEAR))))
    counts = np.bincount(green[inside[:-1] == 0] if coded else green, minlength=256 + LENGTHS)
    far = np.zeros(DISTANCES, np.int64)
    for _, _, a, b in coded:
        counts[256 + a[0]] += 1
        far[b[0]] += 1
    lengths, far_lengths = code_lengths(counts, SHORT_CODES), code_lengths(far)
    write_code(w, lengths)
    for shift in (16, 0, 24):
        write_simple(w, [rest >> shift & 255])
    write_code(w, far_lengths)
    (codes, lengths), (far_codes, far_lengths) = code_table(lengths), code_table(far_lengths)
    begin = 0
    for at, end, a, b in [*coded, (len(green), len(green), None, None)]:
        if at > begin:
            w.write_all(codes[green[begin:at]], lengths[green[begin:at]])
        if a:
            w.write(int(codes[256 + a[0]]), int(lengths[256 + a[0]])), w.write(a[1], a[2])
            w.write(int(far_codes[b[0]]), int(far_lengths[b[0]])), w.write(b[1], b[2])
        begin = end


# -- transforms
def _channels(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p).view(np.uint8).reshape(*p.shape, 4)  # blue, green, red, alpha


def _pixels(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c.astype(np.uint8)).view(np.uint32).reshape(c.shape[:-1])


def predicted(mode: int, left, top, top_right, top_left):
    """Channel arrays (int16) to the prediction of a mode."""
    half = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        to_left = np.abs(top - top_left).sum(axis=-1, keepdims=True)  # how far left + top - top_left is from left
        to_top = np.abs(left - top_left).sum(axis=-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = half(left, top)
        diff = mean - top_left
        return np.clip(mean + np.trunc(diff / 2).astype(np.int16), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255], np.int16), left.shape)


#: Modes that look only at the row above.
ROW_ABOVE = (0, 2, 3, 4, 8, 9)


def _modes(tiles: np.ndarray, bits: int, y: int, width: int) -> np.ndarray:
    m = np.repeat(tiles[y >> bits], 1 << bits)[:width]
    return np.where(m > 13, 0, m)


def forward_predictor(image: np.ndarray, bits: int, tiles: np.ndarray) -> np.ndarray:
    h, w = image.shape
    c = _channels(image).astype(np.int16)
    out = np.empty_like(c)
    for y in range(h):
        left = np.concatenate([c[y, :1], c[y, :-1]])
        if y == 0:
            p = left.copy()
            p[0] = (0, 0, 0, 255)
        else:
            top = c[y - 1]
            top_right = np.concatenate([top[1:], c[y, :1]])
            top_left = np.concatenate([top[:1], top[:-1]])
            modes = _modes(tiles, bits, y, w)
            p = np.empty_like(left)
            for m in np.unique(modes).tolist():
                p[modes == m] = predicted(m, left, top, top_right, top_left)[modes == m]
            p[0] = top[0]
        out[y] = (c[y] - p) & 255
    return _pixels(out)


def inverse_predictor(residual: np.ndarray, bits: int, tiles: np.ndarray) -> np.ndarray:
    h, w = residual.shape
    c = _channels(residual).astype(np.int16)
    c[0, 0] = (c[0, 0] + np.array([0, 0, 0, 255], np.int16)) & 255
    c[0] = np.cumsum(c[0], axis=0, dtype=np.int64) & 255
    for y in range(1, h):
        top, row = c[y - 1], c[y]
        row[0] = (row[0] + top[0]) & 255
        top_right = np.concatenate([top[1:], row[:1]])
        top_left = np.concatenate([top[:1], top[:-1]])
        modes = _modes(tiles, bits, y, w)
        cuts = [1, *(np.flatnonzero(np.diff(modes[1:])) + 2).tolist(), w] if w > 1 else [1]
        for a, b in zip(cuts, cuts[1:], strict=False):
            m = int(modes[a])
            if m in ROW_ABOVE:
                row[a:b] = (row[a:b] + predicted(m, top[a:b], top[a:b], top_right[a:b], top_left[a:b])) & 255
            elif m == 1:
                row[a:b] = (row[a - 1] + np.cumsum(row[a:b], axis=0, dtype=np.int64)) & 255
            else:
                for x in range(a, b):
                    row[x] = (row[x] + predicted(m, row[x - 1], top[x], top_right[x], top_left[x])) & 255
    return _pixels(c)


def cross_colour(image: np.ndarray, bits: int, tiles: np.ndarray, inverse: bool) -> np.ndarray:
    """Tiles hold the multipliers: red to blue in red, green to blue in green, green to red in blue."""
    h, w = image.shape
    t = np.repeat(np.repeat(tiles, 1 << bits, 0), 1 << bits, 1)[:h, :w]
    c = _channels(image).astype(np.int32)
    signed = lambda a: ((a & 255) ^ 128) - 128
    delta = lambda m, v: signed(m) * signed(v) >> 5
    tc = _channels(t).astype(np.int32)
    sign = 1 if inverse else -1
    red = (c[..., 2] + sign * delta(tc[..., 0], c[..., 1])) & 255
    blue = c[..., 0] + sign * (delta(tc[..., 1], c[..., 1]) + delta(tc[..., 2], red if inverse else c[..., 2]))
    c[..., 2], c[..., 0] = red, blue & 255
    return _pixels(c)


def subtract_green(image: np.ndarray, inverse: bool) -> np.ndarray:
    c = _channels(image).astype(np.int16)
    g = c[..., 1:2] if inverse else -c[..., 1:2]
    c[..., [0, 2]] = (c[..., [0, 2]] + g) & 255
    return _pixels(c)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def bundle(index: np.ndarray, bits: int) -> np.ndarray:
    """Palette indices to pixels: 2 ** bits of them in the green of one."""
    if bits:
        per = 1 << bits
        h, w = index.shape
        padded = np.zeros((h, -(-w // per) * per), np.uint32)
        padded[:, :w] = index
        index = (padded.reshape(h, -1, per) << (np.arange(per, dtype=np.uint32) * np.uint32(8 >> bits))).sum(axis=2, dtype=np.uint32)
    return index.astype(np.uint32) << 8 | np.uint32(BLACK)


def unbundle(image: np.ndarray, width: int, bits: int) -> np.ndarray:
    g = image >> 8 & 0xFF
    if bits:
        per, each = 1 << bits, 8 >> bits
        g = (g[:, :, None] >> (np.arange(per, dtype=np.uint32) * np.uint32(each)) & np.uint32((1 << each) - 1)).reshape(len(g), -1)[:, :width]
    return g


# -- files
def decode(data: bytes) -> np.ndarray:
    """A WebP file to ARGB pixels (height x width, uint32)."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, body = 12, None
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            body = data[at + 8 : at + 8 + size]
            break
        at += 8 + size + (size & 1)
    if body is None or body[:1] != b"\x2f":
        raise ValueError("no lossless image in the file")
    r = Reader(body[1:])
    width, height = r.read(14) + 1, r.read(14) + 1
    opaque = not r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    todo, seen, now = [], set(), width
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            tiles = read_image(r, -(-now >> bits), -(-height >> bits), False).reshape(-(-height >> bits), -1)
            todo.append((kind, bits, tiles, now))
        elif kind == PALETTE:
            colours = _channels(read_image(r, size := r.read(8) + 1, 1, False))
            todo.append((kind, _bundle_bits(size), _pixels(np.cumsum(colours, axis=0, dtype=np.int64) & 255), now))
            now = -(-now >> _bundle_bits(size))
        else:
            todo.append((kind, 0, None, now))
    image = read_image(r, now, height, True).reshape(height, now)
    for kind, bits, t, before in reversed(todo):
        if kind == PREDICTOR:
            image = inverse_predictor(image, bits, (t >> 8 & 0xF).astype(np.int64))
        elif kind == CROSS_COLOUR:
            image = cross_colour(image, bits, t, True)
        elif kind == SUBTRACT_GREEN:
            image = subtract_green(image, True)
        else:
            index = unbundle(image, before, bits)
            image = np.append(t, np.zeros(256 - len(t), np.uint32))[index]
    return image | np.uint32(BLACK) if opaque else image


def encode(image: np.ndarray, transforms=(), cache_bits: int = 0, matches=None, tiles=None, opaque: bool = False) -> bytes:
    """ARGB pixels to a WebP file.  ``transforms`` in the order in which they are applied: ``(PREDICTOR, bits, modes)``,
    ``(CROSS_COLOUR, bits, multipliers)``, ``(SUBTRACT_GREEN,)``, ``(PALETTE,)`` or ``(PALETTE, colours, indices)``; matches and tiles as in ``write_image``."""
    h, w = image.shape
    if not (0 < h <= MAX_SIDE and 0 < w <= MAX_SIDE):
        raise ValueError(f"an image has 1 to {MAX_SIDE} pixels a side")
    out = Writer()
    out.write(w - 1, 14), out.write(h - 1, 14), out.write(0 if opaque else 1, 1), out.write(0, 3)
    for t in transforms:
        out.write(1, 1), out.write(t[0], 2)
        if t[0] == PREDICTOR:
            out.write(t[1] - 2, 3)
            write_image(out, (t[2].ravel().astype(np.uint32) << 8) | np.uint32(BLACK), t[2].shape[1], False)
            image = forward_predictor(image, t[1], t[2])
        elif t[0] == CROSS_COLOUR:
            out.write(t[1] - 2, 3)
            write_image(out, t[2].ravel().astype(np.uint32), t[2].shape[1], False)
            image = cross_colour(image, t[1], t[2], False)
        elif t[0] == SUBTRACT_GREEN:
            image = subtract_green(image, False)
        else:
            colours, index = t[1:] if len(t) > 1 else np.unique(image, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("a palette has 256 colours at most")
            out.write(len(colours) - 1, 8)
            deltas = np.diff(_channels(colours).astype(np.int16), axis=0, prepend=np.zeros((1, 4), np.int16)) & 255
            write_image(out, _pixels(deltas), len(colours), False)
            image = bundle(index.reshape(h, w), _bundle_bits(len(colours)))
    out.write(0, 1)
    write_image(out, image.ravel(), image.shape[1], True, cache_bits, matches, tiles)
    body = b"\x2f" + out.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


# -- samples
def line_matches(data: bytes, least: int = MIN_MATCH, most: int = MAX_MATCH) -> list[tuple[int, int, int]]:
    """Back-references of lines (with their newline) that came before, adjoining ones together."""
    last: dict[bytes, int] = {}
    out: list[tuple[int, int, int]] = []
    at = 0
    for line in data.split(b"\n"):
        n = len(line) + 1
        if n > least and at + n <= len(data):
            before = last.get(line)
            if before is not None:
                for k in range(0, n, most):
                    size = min(most, n - k)
                    if out and out[-1][0] + out[-1][2] == at + k and out[-1][1] == at - before and out[-1][2] + size <= most:
                        out[-1] = (out[-1][0], out[-1][1], out[-1][2] + size)
                    else:
                        out.append((at + k, at - before, size))
            last[line] = at
        at += n
    return out


def shape_of(n: int) -> tuple[int, int]:
    """Height and width of an image of ``n`` samples, a multiple of 64: 64 wide, wider only if it would be too high."""
    width = 64 * -(-n // (64 * MAX_SIDE))
    if width > MAX_SIDE:
        raise ValueError("more samples than an image holds")
    return -(-n // width), width


#: Samples of the largest image; more are stored in several, one file after the other.
FRAME = MAX_SIDE * MAX_SIDE


def encode_samples(payload: bytes, frame: int = FRAME) -> bytes:
    """8-bit samples, a positive multiple of 64 of them, as a WebP file: grey values in green, palette, back-references.  More than
    ``frame`` samples (which must fill an image) are several files in a row."""
    if len(payload) > frame:
        return b"".join([encode_samples(payload[k : k + frame], frame) for k in range(0, len(payload), frame)])
    h, w = shape_of(len(payload))
    padded = payload + b"\0" * (h * w - len(payload))
    samples = np.frombuffer(padded, np.uint8).reshape(h, w)
    values = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    index = np.zeros(256, np.uint32)
    index[values] = np.arange(len(values))
    matches = None if len(values) <= 16 else line_matches(padded)  # a small palette packs several samples into a pixel
    return encode(samples, [(PALETTE, values.astype(np.uint32) << 8, index[samples])], matches=matches, opaque=True)


def decode_samples(data: bytes) -> np.ndarray:
    """The samples (height x width, uint8) of a WebP file whose green channel holds them; of several files in a row as one array, 64 wide."""
    found, at = [], 0
    while not found or data[at : at + 4] == b"RIFF":
        size = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        found.append((decode(data if size >= len(data) else data[at : at + size]) >> 8 & 0xFF).astype(np.uint8))
        at += size
    return found[0] if len(found) == 1 else np.concatenate([x.ravel() for x in found]).reshape(-1, 64)


def feature(samples: np.ndarray) -> str:
    """A short description of a pixel array: shape, number of values, mean, entropy in bits, mean step between neighbours."""
    counts = np.bincount(samples.ravel(), minlength=256)
    p = counts[counts > 0] / samples.size
    step = np.abs(np.diff(samples.ravel().astype(np.int16))).mean() if samples.size > 1 else 0.0
    return f"{samples.shape[0]}x{samples.shape[1]} values={len(p)} mean={samples.mean():.4f} entropy={abs(-(p * np.log2(p)).sum()):.4f} step={step:.4f}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def _map(df: DataFrame, columns: list[tuple[str, str, str]], schema: str, make, types: list[pa.DataType]) -> DataFrame:
    """``make(row values)`` gives the values of a row; batches are handed on when they are large."""
    names = [s.split(" ")[0] for s in schema.split(", ")]
    bounded_batches(df.sparkSession)

    def run(rows):
        for batch in rows:
            out, size = [], 0
            for k in range(batch.num_rows):
                out.append(make(*(batch.column(c)[k].as_py() for c in range(batch.num_columns))))
                size += sum(len(x) for x in out[-1] if isinstance(x, bytes))
                if size >= 8 << 20 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, size = [], 0

    return df.select(*[F.col(c).cast(t).alias(n) for c, n, t in columns]).mapInArrow(run, schema)


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, media)`` for every row: the text's bytes, padded with zeros to a positive multiple of 64, as a WebP file.

    A null text is empty: 64 zeros.  Keys are integers; null ones and repeated rows are kept; other columns aren't looked at.  A text of more than
    2**28 bytes has several files in a row."""

    def make(key, text):
        n, payload = payload_of(text)
        return key, n, encode_samples(payload)

    made = _map(docs, [(key, "key", "long"), (text, "text", "string")], "key long, n_bytes long, media binary", make, [pa.int64(), pa.int64(), pa.binary()])
    return made.withColumnRenamed("key", key)


def decode_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, n_bytes, media, height, width, pixels, feature)``: the pixel arrays (8-bit samples, row by row) of a column of WebP
    files.  A null file gives nulls."""

    def make(key, n, data):
        if data is None:
            return key, n, None, None, None, None, None
        s = decode_samples(data)
        return key, n, data, s.shape[0], s.shape[1], s.tobytes(), feature(s)

    schema = "key long, n_bytes long, media binary, height int, width int, pixels binary, feature string"
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    return _map(media, [(key, "key", "long"), ("n_bytes", "n_bytes", "long"), ("media", "media", "binary")], schema, make, types).withColumnRenamed("key", key)


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    size = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / 64)) * 64
    d = decoded.withColumn("payload", F.substring("pixels", F.lit(1), size.cast("int")))
    return d.select(
        F.col(key).alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", F.octet_length("payload") - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
