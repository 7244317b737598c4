"""Lossless WebP images in numpy: a decoder for the whole format, and an encoder that compresses.

The decoder reads prefix codes (simple and normal, grouped by an entropy image), back-references, the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Where only green varies, as with a palette or shades of grey, what a token would be is looked up at
all bits of a stretch at once, the tokens are picked by a walk from one to the next, and runs are copied whole; other images take a general loop over symbols.

The encoder subtracts green where that leaves red and blue with less, then takes a palette for few colours, bundling pixels where it can, or else
predicts rows from the left or from above where residuals have less entropy. Repeated stretches become back-references, and all symbols get prefix codes fitted to the image.
It writes neither entropy images, nor colour caches, nor cross-colour transforms.

Damaged streams raise ValueError.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from itertools import groupby

import numpy as np

MAX_SIDE = 16384
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
#: Fixed values of the format: order in which lengths of the code-length code are written.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: offsets (x, y) that short distance codes stand for.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
GREEN, RED, BLUE, ALPHA = 1, 0, 2, 3  # channels in pixel arrays; in streams they come in this order
STREAM = (GREEN, RED, BLUE, ALPHA)


def reversed_bits(width: int) -> np.ndarray:
    """Codes 0, 1, ... of a width, first bit lowest."""
    x, out = np.arange(1 << width, dtype=np.uint32), np.zeros(1 << width, np.uint32)
    for i in range(width):
        out |= ((x >> np.uint32(i)) & np.uint32(1)) << np.uint32(width - 1 - i)
    return out


_REVERSED = [reversed_bits(w).astype(np.int64) for w in range(16)]


# ---- encoder

#: Longest codes that are written (short ones need small tables, and no code with its extra bits passes 32 bits); and pixels that a back-reference is worth at least.
LONGEST, WORTH, FARTHEST, MOST = 9, 6, 2**20 - 120, 4096


class _Bits:
    """Header fields one by one, then items as arrays."""

    def __init__(self) -> None:
        self.value, self.count = 0, 0

    def put(self, value: int, count: int) -> None:
        self.value |= value << self.count
        self.count += count

    def put_items(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """values[i] in sizes[i] bits, 32 at most each."""
        sizes = sizes.astype(np.int64)
        ends = np.cumsum(sizes)
        at = ends - sizes
        wide = values.astype(np.uint64) << (at & 31).astype(np.uint64)
        words = int(ends[-1] >> 5) + 2
        # items share no bit, so sums are exact
        low = np.bincount(at >> 5, (wide & np.uint64(0xFFFFFFFF)).astype(float), words + 1)
        low[1:] += np.bincount(at >> 5, (wide >> np.uint64(32)).astype(float), words + 1)[:-1]
        self.put(int.from_bytes(low.astype("<u4").tobytes(), "little"), int(ends[-1]))

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.count + 7) // 8, "little")


def code_lengths(counts: list[int], longest: int) -> list[int]:
    """Lengths of an optimal prefix code for symbols of positive counts; counts are evened out until none is above longest."""
    n = len(counts)
    if n == 1:
        return [1]
    while True:
        order = sorted(range(n), key=counts.__getitem__)
        # leaves and inner nodes, both by weight: the two lightest are at the heads of two queues
        leaves, inner = [*(counts[i] for i in order), _NO_MORE], [_NO_MORE] * n
        leaf_up, inner_up = [0] * n, [0] * n
        i = j = 0
        for made in range(n - 1):
            total = 0
            for _ in (0, 1):
                if leaves[i] <= inner[j]:
                    total += leaves[i]
                    leaf_up[i] = made
                    i += 1
                else:
                    total += inner[j]
                    inner_up[j] = made
                    j += 1
            inner[made] = total
        depth = [1] * (n - 1)  # of an inner node's children
        for k in range(n - 3, -1, -1):
            depth[k] = depth[inner_up[k]] + 1
        if depth[leaf_up[0]] <= longest:  # the lightest leaf is as deep as any
            out = [0] * n
            for place, symbol in enumerate(order):
                out[symbol] = depth[leaf_up[place]]
            return out
        counts = [(c >> 1) + 1 for c in counts]


_NO_MORE = 1 << 60


def canonical(symbols: np.ndarray, lengths: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Code, first bit lowest, and its length, by symbol; symbols ascend."""
    order = np.argsort(lengths, kind="stable")
    n, s = lengths[order].astype(np.int64), symbols[order]
    steps = 1 << (15 - n)
    first = (np.cumsum(steps) - steps) >> (15 - n)
    codes, sizes = np.zeros(alphabet, np.int64), np.zeros(alphabet, np.int64)
    codes[s], sizes[s] = _REVERSED[15][first] >> (15 - n), n
    return codes, sizes


def _runs(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, extra bits, their number) of the code lengths, runs written short."""
    out, before = [], 8
    for x, same in groupby(lengths):
        run = len(list(same))
        if x == 0:
            while run >= 3:
                take = min(run, 138)
                out.append((18, take - 11, 7) if take > 10 else (17, take - 3, 3))
                run -= take
        else:
            if x != before:
                out.append((x, 0, 0))
                run, before = run - 1, x
            while run >= 3:
                take = min(run, 6)
                out.append((16, take - 3, 2))
                run -= take
        out += [(x, 0, 0)] * run
    return out


#: Lengths of the codes that code lengths up to LONGEST and their runs are written in; those that occur most have shorter ones.
_RUN_SIZES = [3 if s in (0, 6, 8) else 4 if s <= LONGEST or s > 15 else 0 for s in range(19)]
_RUN_CODES = canonical(np.flatnonzero(_RUN_SIZES), np.array([n for n in _RUN_SIZES if n]), 19)[0].tolist()


def _run_header() -> tuple[int, int]:
    """What announces these codes, and its bits."""
    out = _Bits()
    listed = max(i for i, s in enumerate(CODE_LENGTH_ORDER) if _RUN_SIZES[s]) + 1
    out.put(0, 1)
    out.put(listed - 4, 4)
    for s in CODE_LENGTH_ORDER[:listed]:
        out.put(_RUN_SIZES[s], 3)
    return out.value, out.count


_RUN_HEADER = _run_header()


def _put_code(out: _Bits, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code fitted to the counts of an alphabet's symbols. Codes and their lengths; a lone symbol takes no bits."""
    symbols = np.flatnonzero(counts)
    if len(symbols) <= 2 and (not len(symbols) or symbols[-1] < 256):
        used = symbols.tolist() or [0]
        out.put(1 | (len(used) - 1) << 1, 2)
        out.put(int(used[0] > 1), 1)
        out.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        codes, sizes = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        if len(used) == 2:
            codes[used[1]], sizes[used] = 1, 1
        return codes, sizes
    lengths = np.array(code_lengths(counts[symbols].tolist(), LONGEST), np.int64)
    by_symbol = np.zeros(int(symbols[-1]) + 1, np.int64)
    by_symbol[symbols] = lengths
    runs = _runs(by_symbol.tolist())
    out.put(*_RUN_HEADER)
    n = len(runs) - 2  # how many runs follow, as they stop short of the alphabet
    if len(runs) < 2:
        out.put(0, 1)  # a lone symbol of an alphabet's end
    else:
        wide = max(1, (n.bit_length() + 1) // 2)
        out.put(1, 1)
        out.put(wide - 1, 3)
        out.put(n, 2 * wide)
    for s, extra, bits in runs:
        out.put(_RUN_CODES[s] | extra << _RUN_SIZES[s], _RUN_SIZES[s] + bits)
    if len(symbols) == 1:
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    return canonical(symbols, lengths, len(counts))


def prefixed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths or distance codes from 1."""
    x = x.astype(np.int64) - 1
    high = np.frexp(x.astype(float))[1].astype(np.int64) - 1
    extra = np.maximum(high - 1, 0)
    return np.where(x < 4, x, 2 * high + ((x >> extra) & 1)), np.where(x < 4, 0, x & ((1 << extra) - 1)), np.where(x < 4, 0, extra)


def walked(next_: np.ndarray, start: int, stop: int) -> np.ndarray:
    """start, and from each place the one that next_ has there, always a later one, as long as they are below stop (at most the length of next_).

    Leaps of eight are made first; Python walks by them, and what lies between is looked up for all at once.
    """
    n = len(next_)
    one = np.append(np.minimum(next_, n), next_.dtype.type(n))
    one[stop:] = np.arange(stop, n + 1)
    two = one.take(one)
    four = two.take(two)
    places, p, leap = [], start, memoryview(four.take(four))
    add = places.append
    while p < stop:
        add(p)
        p = leap[p]
    out = np.array(places, next_.dtype)
    for between in (four, two, one):
        out = np.stack([out, between.take(out)], axis=1).ravel()
    return out[out < stop]


def matches(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of stretches that repeat earlier ones, from left to right and without overlap.

    Positions are known by a hash of the next WORTH values. Sorted by it, each finds the last one before it; where neighbours find neighbours, the match goes on.
    """
    n = len(v) - WORTH + 1
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    small = int(v.max()) < 256  # then the hash is the values themselves
    by = np.uint64(256 if small else 0x100000001B3)
    h = v[:n].copy()
    for i in range(1, WORTH):
        h *= by
        h += v[i : n + i]
    keys = np.sort((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(28) << np.uint64(28)) | np.arange(n, dtype=np.uint64))
    place = (keys & np.uint64(2**28 - 1)).astype(np.int64)
    same = np.flatnonzero((keys[1:] >> np.uint64(28)) == (keys[:-1] >> np.uint64(28)))
    at, from_ = place[same + 1], place[same]
    fits = (h[at] == h[from_]) & (at - from_ <= FARTHEST)
    for i in range(0 if small else WORTH):
        fits &= v[at + i] == v[from_ + i]
    if not fits.all():
        at, from_ = at[fits], from_[fits]
    if not len(at):
        return none, none, none
    before = np.full(n + 1, -2, np.int64)
    before[at] = from_
    has = before[:-1] >= 0
    ends_here = ~has | (before[1:] != before[:-1] + 1)
    at = np.flatnonzero(has)
    length = np.flatnonzero(ends_here)[np.cumsum(ends_here, dtype=np.int32)[at] - ends_here[at]] - at + WORTH
    # where a match ends inside a repeated stretch, the next one starts
    chosen = walked(np.cumsum(has, dtype=np.int32).take(at + length - 1, mode="clip"), 0, len(at))
    start, size, far = at[chosen], length[chosen], (at - before[at])[chosen]
    if size.max() > MOST:
        times = -(-size // MOST)
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        start, size, far = np.repeat(start, times) + part * MOST, np.minimum(np.repeat(size, times) - part * MOST, MOST), np.repeat(far, times)
    return start, size, far


@lru_cache(16)
def near_codes(width: int) -> np.ndarray:
    """The short code of each small distance in rows of width, 0 where there is none."""
    distances = near_distances(width)
    table = np.zeros(max(distances) + 1, np.int64)
    for code in range(len(NEAR), 0, -1):
        table[distances[code]] = code
    return table


def _put_image(out: _Bits, channels: list[np.ndarray], width: int, main: bool) -> None:
    """channels: green, red, blue and alpha of all pixels, None for one that is 0 throughout. Stretches of the main image are referred to."""
    out.put(0, 2 if main else 1)  # no colour cache, no entropy image
    green, n = channels[0], len(channels[0])
    start = np.zeros(0, np.int64)
    if main:
        v = green.astype(np.uint64)
        for i, c in enumerate(channels[1:]):
            if c is not None:
                v = v | c.astype(np.uint64) << np.uint64(8 * i + 8)
        start, size, far = matches(v)
    if not len(start):
        token, literal, spelt = green, slice(None), slice(None)
    else:
        covered = np.zeros(n + 1, np.int8)
        covered[start] += 1
        covered[start + size] -= 1
        first = np.cumsum(covered[:-1], dtype=np.int8) == 0  # pixels that begin a token
        refers = np.zeros(n, bool)
        first[start] = refers[start] = True
        pixel = np.flatnonzero(first)
        refers = refers[pixel]
        literal, refers = np.flatnonzero(~refers), np.flatnonzero(refers)
        spelt = pixel[literal]
        symbol, extra, bits = prefixed(size)
        token = np.empty(len(pixel), np.int64)
        token[literal], token[refers] = green[spelt], LITERALS + symbol
    codes, sizes = _put_code(out, np.bincount(token, minlength=LITERALS + LENGTHS))
    wide = sum(c is not None for c in channels[1:]) > 0
    values, widths = np.zeros((len(token), 2 + wide), np.int64), np.zeros((len(token), 2 + wide), np.int64)
    values[:, 0], widths[:, 0] = codes[token], sizes[token]
    for j, c in zip((1, 1, 2), channels[1:]):
        if c is None:
            out.put(1, 4)  # one symbol, 0
            continue
        x = c[spelt]
        codes, sizes = _put_code(out, np.bincount(x, minlength=256))
        values[literal, j] |= codes[x] << widths[literal, j]
        widths[literal, j] += sizes[x]
    if not len(start):
        out.put(1, 4)
    else:
        values[refers, 0] |= extra << widths[refers, 0]
        widths[refers, 0] += bits
        near = near_codes(width)
        short = near[np.minimum(far, len(near) - 1)] * (far < len(near))
        symbol, extra, bits = prefixed(np.where(short > 0, short, far + len(NEAR)))
        codes, sizes = _put_code(out, np.bincount(symbol, minlength=DISTANCES))
        values[refers, 1 + wide] = codes[symbol] | extra << sizes[symbol]
        widths[refers, 1 + wide] = sizes[symbol] + bits
    out.put_items(values.ravel(), widths.ravel())


def _cost(p: np.ndarray) -> float:
    """About how many bits a pixel takes: its channels' collision entropies."""
    n = p[..., 0].size
    return -sum(np.log2(float(c @ c) / n**2) for c in (np.bincount(p[..., i].ravel(), minlength=256).astype(float) for i in range(p.shape[-1])))


def _residuals(p: np.ndarray, mode: int) -> np.ndarray:
    """What is left of uint8[height, width, channels] when pixels are predicted from the left (1) or from above (2); alpha isn't among the channels or starts at 255."""
    before = np.empty_like(p)
    before[0, 0] = (0, 0, 0, 255)[: p.shape[2]]
    before[0, 1:], before[1:, 0] = p[0, :-1], p[:-1, 0]
    before[1:, 1:] = p[1:, :-1] if mode == 1 else p[:-1, 1:]
    return p - before


def encode(pixels: np.ndarray) -> bytes:
    """A file for pixels, uint8[height, width, 4] as red, green, blue, alpha, or uint8[height, width] as shades of grey."""
    height, width = pixels.shape[:2]
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError(f"an image can't have {width} x {height} pixels")
    out = _Bits()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    grey = pixels.ndim == 2
    clear = not grey and bool((pixels[:, :, ALPHA] != 255).any())
    out.put(int(clear), 1)
    out.put(0, 3)
    # channels as green, red, blue, alpha; what is 0 throughout is None
    if grey:
        planes = pixels.reshape(height, width, 1)
    else:
        planes = pixels[:, :, list(STREAM[: 3 + clear])]
        less = planes.copy()
        less[:, :, 1:3] -= less[:, :, :1]
    minus_green = grey or _cost(less) < _cost(planes)
    if minus_green:
        planes = planes if grey else less
        out.put(1, 1)
        out.put(2, 2)
    flat = planes.reshape(-1, planes.shape[2])
    if grey:
        colours = np.flatnonzero(np.bincount(flat[:, 0], minlength=256))
        index_of = np.zeros(256, np.uint8)
        index_of[colours] = np.arange(len(colours))
        index, colours = index_of[flat[:, 0]], colours.reshape(-1, 1)
    else:
        joined = np.zeros(len(flat), np.uint32)
        for i in range(flat.shape[1]):
            joined |= flat[:, i].astype(np.uint32) << np.uint32(8 * i)
        keys, index = np.unique(joined, return_inverse=True)
        colours = np.stack([keys >> np.uint32(8 * i) & np.uint32(255) for i in range(flat.shape[1])], axis=1).astype(np.int64)
    if len(colours) <= (16 if grey else min(256, max(2, len(flat) // 4))):
        out.put(1, 1)
        out.put(3, 2)
        out.put(len(colours) - 1, 8)
        steps = (np.diff(colours, axis=0, prepend=np.zeros((1, colours.shape[1]), np.int64)) & 255).astype(np.uint8)
        _put_image(out, [steps[:, i] if i < steps.shape[1] else None for i in range(4)], len(colours), False)
        bits = 1 if len(colours) <= 2 else 2 if len(colours) <= 4 else 4 if len(colours) <= 16 else 8
        if bits < 8:
            rows, per = index.reshape(height, width).astype(np.uint8), 8 // bits
            rows = np.pad(rows, ((0, 0), (0, -width % per))).reshape(height, -1, per)
            width = rows.shape[1]
            index = np.bitwise_or.reduce(rows << np.arange(0, 8, bits, dtype=np.uint8), axis=2).ravel()
        flat = index.reshape(-1, 1)
    else:
        plain = {0: planes, 1: _residuals(planes, 1), 2: _residuals(planes, 2)}
        mode = min(plain, key=lambda m: _cost(plain[m]) * (1.15 if m else 1.0))  # a prediction must be clearly better, as it hides repeats
        if mode:
            out.put(1, 1)
            out.put(0, 2)
            out.put(7, 3)  # blocks of 512
            tiles = (-(-width // 512)) * (-(-height // 512))
            _put_image(out, [np.full(tiles, mode, np.uint8), None, None, None], -(-width // 512), False)
        flat = plain[mode].reshape(-1, planes.shape[2])
    out.put(0, 1)
    _put_image(out, [flat[:, i] if i < flat.shape[1] else None for i in range(4)], width, True)
    data = out.bytes()
    pad = len(data) & 1
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(data) + pad, b"WEBP", b"VP8L", len(data)) + data + b"\0" * pad


# ---- decoder


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def get(self, count: int) -> int:
        i = self.at >> 3
        out = int.from_bytes(self.data[i : i + 9], "little") >> (self.at & 7) & ((1 << count) - 1)
        self.at += count
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return out


class _Code:
    """A prefix code by the lengths of its symbols."""

    def __init__(self, lengths: np.ndarray):
        self.symbols = np.flatnonzero(lengths)
        n = lengths[self.symbols]
        if len(n) == 1:  # a lone symbol takes no bits
            self.lone = int(self.symbols[0])
        else:
            if not len(n) or int((1 << (15 - n.astype(int))).sum()) != 1 << 15:
                raise ValueError("a prefix code isn't complete")
            self.lone = None
        self.lengths, self._table, self._arrays = lengths, None, None

    def arrays(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Longest length; symbol and length by the next bits."""
        if self._arrays is None:
            if self.lone is not None:
                self._arrays = 0, np.array([self.lone]), np.zeros(1, np.int64)
            else:
                n = self.lengths[self.symbols].astype(np.int64)
                order = np.argsort(n, kind="stable")
                longest = int(n[order[-1]])
                times = 1 << (longest - n[order])
                turned = _REVERSED[longest]
                self._arrays = longest, self.symbols[order].repeat(times)[turned], n[order].repeat(times)[turned]
        return self._arrays

    def table(self) -> tuple[int, list[int], list[int]]:
        if self._table is None:
            longest, symbol, length = self.arrays()
            self._table = longest, symbol.tolist(), length.tolist()
        return self._table

    def read(self, r: _Reader) -> int:
        if self.lone is not None:
            return self.lone
        longest, symbol, length = self.table()
        i = r.at >> 3
        x = int.from_bytes(r.data[i : i + 4], "little") >> (r.at & 7) & ((1 << longest) - 1)
        r.at += length[x]
        if r.at > r.end:
            raise ValueError("the stream ends early")
        return symbol[x]


@lru_cache(1024)
def _code_of(symbols: tuple[int, ...], sizes: tuple[int, ...], alphabet: int) -> _Code:
    lengths = np.zeros(alphabet, np.uint8)
    lengths[list(symbols)] = sizes
    return _Code(lengths)


def _read_code(r: _Reader, alphabet: int) -> _Code:
    if r.get(1):
        two, wide = r.get(1), r.get(1)
        symbols = [r.get(8 if wide else 1)] + ([r.get(8)] if two else [])
        if max(symbols) >= alphabet:
            raise ValueError("a symbol is outside its alphabet")
        return _code_of(tuple(set(symbols)), (1,) * len(set(symbols)), alphabet)
    listed = 4 + r.get(4)
    x = r.get(3 * listed)
    code = _code_of(CODE_LENGTH_ORDER[:listed], tuple(x >> 3 * i & 7 for i in range(listed)), 19)
    lengths = np.zeros(alphabet, np.uint8)
    limit = alphabet
    if r.get(1):
        limit = 2 + r.get(2 + 2 * r.get(3))
        if limit > alphabet:
            raise ValueError("too many code lengths")
    longest, symbol, size = code.table()
    mask, at, before, found = (1 << longest) - 1, 0, 8, []
    ahead, p = 0, 0  # the next bits, and how many of them are read
    base, end = r.at, 0
    while at < alphabet and limit > 0:
        limit -= 1
        if p >= end:
            base, p, end = base + p, 0, 4096
            ahead = int.from_bytes(r.data[base >> 3 : (base >> 3) + 520], "little") >> (base & 7)
        x = ahead >> p & mask
        p += size[x]
        x = symbol[x]
        if x < 16:
            found.append(x)
            at += 1
            before = x or before
            continue
        bits = (2, 3, 7)[x - 16]
        times = (ahead >> p & ((1 << bits) - 1)) + (11 if x == 18 else 3)
        p += bits
        found += [before if x == 16 else 0] * times
        at += times
    r.at = base + p
    if at > alphabet:
        raise ValueError("too many code lengths")
    if r.at > r.end:
        raise ValueError("the stream ends early")
    lengths[:at] = found
    return _Code(lengths)


def _extended_one(r: _Reader, prefix: int) -> int:
    """Value of a length or distance prefix."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.get(extra) + 1


def _read_image(r: _Reader, width: int, height: int, main: bool) -> np.ndarray:
    """uint8[height, width, 4]"""
    cache_bits = r.get(4) if r.get(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    cache_size = 1 << cache_bits if cache_bits else 0
    meta, block, groups = None, 0, 1
    if main and r.get(1):
        block = r.get(3) + 2
        image = _read_image(r, (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
        meta = image[:, :, RED].astype(int) << 8 | image[:, :, GREEN]
        groups = int(meta.max()) + 1
    codes = [[_read_code(r, n) for n in (LITERALS + LENGTHS + cache_size, 256, 256, 256, DISTANCES)] for _ in range(groups)]
    if groups == 1 and not cache_size and all(c.lone is not None for c in codes[0][1:4]):
        green = _read_greens(r, width, height, codes[0])
        out = np.empty((height, width, 4), np.uint8)
        out[:, :, GREEN] = green
        for c, code in zip(STREAM[1:], codes[0][1:4]):
            out[:, :, c] = code.lone
        return out
    return _read_symbols(r, width, height, codes, meta, block, cache_bits)


#: Bit positions that are looked up at a time.
STRETCH = 1 << 17


def _read_greens(r: _Reader, width: int, height: int, codes: list[_Code]) -> np.ndarray:
    """uint8[height, width] of an image whose other channels have one value each, as with a palette or shades of grey.

    For each bit of a stretch of the stream, the symbol that a token beginning there would have is looked up, and where the next token would begin.
    """
    n, done = width * height, 0
    if codes[0].lone is not None:
        if codes[0].lone < LITERALS:
            return np.full((height, width), codes[0].lone, np.uint8)
        raise ValueError("a back-reference leaves the image")  # nothing comes before the first one
    longest, symbol_of, size_of = codes[0].arrays()
    joint = (symbol_of << 4 | size_of).astype(np.int32)
    far_longest, far_symbol, far_size = codes[4].arrays()
    far_of = (far_symbol << 4 | far_size).astype(np.int32)
    data = np.frombuffer(r.data + b"\0" * 20, np.uint8)
    out, near = bytearray(n), np.array(near_distances(width), np.int32)
    pixels = np.frombuffer(out, np.uint8)
    while done < n:
        first = r.at >> 3
        count = min(STRETCH, r.end - 8 * first)
        raw = data[first : first + (count + 7 >> 3) + 12].astype(np.uint32)
        words = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
        ahead = (words[:, None] >> _SHIFTS).ravel().view(np.int32)  # 25 bits from each position on
        token = joint.take(ahead[:count] & ((1 << longest) - 1))
        after = (token & 15) + np.arange(count, dtype=np.int32)
        token >>= 4
        copies = np.flatnonzero(token > 255)
        if len(copies):
            size, at = _extended(token[copies] - LITERALS, after[copies], ahead)
            code = far_of.take(ahead.take(at) & ((1 << far_longest) - 1))
            far, at = _extended(code >> 4, at + (code & 15), ahead)
            after[copies] = at
        at = walked(after, r.at - 8 * first, min(count, STRETCH - 64) if count == STRETCH else count)
        if not len(at):
            raise ValueError("the stream ends early")
        p, token = int(after[at[-1]]), token[at]
        which = np.flatnonzero(token > 255)
        place = np.searchsorted(copies, at[which])
        times = np.ones(len(at), np.int64)
        if len(which):
            times[which] = size[place]
        ends = np.cumsum(times) + done
        if ends[-1] >= n:  # the image is complete before the last of them
            last = int(np.searchsorted(ends, n))
            if ends[last] > n:
                raise ValueError("a back-reference leaves the image")
            p = int(after[at[last]])
            token, ends, times, which = token[: last + 1], ends[: last + 1], times[: last + 1], which[: np.searchsorted(which, last + 1)]
        r.at = p + 8 * first
        if r.at > r.end:
            raise ValueError("the stream ends early")
        starts = ends - times
        pixels[starts] = token.astype(np.uint8)  # at references, what is copied comes over it
        if len(which):
            starts, d = starts[which], far[place[: len(which)]]
            d = np.where(d > len(NEAR), d - len(NEAR), near.take(np.minimum(d, len(NEAR))))
            if (d > starts).any():
                raise ValueError("a back-reference leaves the image")
            for at, k, d in zip(starts.tolist(), times[which].tolist(), d.tolist()):
                while d < k:  # what was just copied is copied on
                    out[at : at + d] = out[at - d : at]
                    at, k = at + d, k - d
                    d += d
                out[at : at + k] = out[at - d : at - d + k]
        done = int(ends[-1])
    return pixels.reshape(height, width)


_SHIFTS = np.arange(8, dtype=np.uint32)


def _extended(prefix: np.ndarray, at: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of length or distance prefixes whose extra bits begin at these positions, and where these end."""
    extra = np.maximum((prefix - 2) >> 1, 0)
    value = ((2 + (prefix & 1)) << extra) + (ahead.take(at) & ((1 << extra) - 1)) + 1
    return np.where(prefix < 4, prefix + 1, value), at + extra


@lru_cache(64)
def near_distances(width: int) -> list[int]:
    """The distances that codes of them from 1 on stand for in rows of width, if they are short."""
    return [0, *(max(1, x + y * width) for x, y in NEAR)]


def _read_symbols(r: _Reader, width: int, height: int, codes: list[list[_Code]], meta: np.ndarray | None, block: int, cache_bits: int) -> np.ndarray:
    n, done = width * height, 0
    pixels = [0] * n  # alpha, red, green, blue from the highest byte
    cache, cached = [0] * (1 << cache_bits), 0
    groups, near = codes[0], near_distances(width)
    while done < n:
        if meta is not None:
            groups = codes[meta[done // width >> block, done % width >> block]]
        s = groups[0].read(r)
        if s < LITERALS:
            red, blue, alpha = groups[1].read(r), groups[2].read(r), groups[3].read(r)
            pixels[done] = alpha << 24 | red << 16 | s << 8 | blue
            done += 1
        elif s < LITERALS + LENGTHS:
            length = _extended_one(r, s - LITERALS)
            d = _extended_one(r, groups[4].read(r))
            d = d - len(NEAR) if d > len(NEAR) else near[d]
            if d > done or done + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                pixels[done] = pixels[done - d]
                done += 1
        else:
            if cache_bits:
                for p in pixels[cached:done]:
                    cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = p
                cached = done
            pixels[done] = cache[s - LITERALS - LENGTHS]
            done += 1
    argb = np.array(pixels, dtype=np.uint32)
    return np.stack([argb >> s & 255 for s in (16, 8, 0, 24)], axis=1).astype(np.uint8).reshape(height, width, 4)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predicted(mode: int, left, top, top_left, top_right):
    """Prediction from int arrays [..., 4]."""
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255]) + 0 * top
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode < 10:
        a, b = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return _average(a, b)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(), np.abs(left - top_left).sum()
        return left if to_left < to_top else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    middle = _average(left, top)
    d = middle - top_left
    return np.clip(middle + np.where(d < 0, -(-d // 2), d // 2), 0, 255)


#: Modes that don't look at the left pixel, so that a stretch of a row is predicted at once.
_FROM_ABOVE = frozenset((0, 2, 3, 4, 8, 9, 14, 15))


def _unpredict(residuals: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width, _ = residuals.shape
    out = residuals.astype(int)
    out[0, 0] = (out[0, 0] + (0, 0, 0, 255)) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255  # the first row is predicted from the left
    for y in range(1, height):
        above = out[y - 1]
        out[y, 0] = (out[y, 0] + above[0]) & 255
        for x0 in range(0, width, 1 << block):
            mode = int(modes[y >> block, x0 >> block])
            a, b = max(x0, 1), min(x0 + (1 << block), width)
            if a >= b:
                continue
            right = above[a + 1 : b + 1] if b < width else np.concatenate([above[a + 1 :], out[y, :1]])
            if mode in _FROM_ABOVE:
                out[y, a:b] = (out[y, a:b] + _predicted(mode, None, above[a:b], above[a - 1 : b - 1], right)) & 255
            elif mode == 1:
                out[y, a:b] = (np.cumsum(out[y, a:b], axis=0) + out[y, a - 1]) & 255
            else:
                for x in range(a, b):
                    out[y, x] = (out[y, x] + _predicted(mode, out[y, x - 1], above[x], above[x - 1], right[x - a])) & 255
    return out.astype(np.uint8)


def _add_green(pixels: np.ndarray) -> np.ndarray:
    out = pixels.copy()
    out[:, :, RED] += pixels[:, :, GREEN]
    out[:, :, BLUE] += pixels[:, :, GREEN]
    return out


def _uncross(pixels: np.ndarray, multipliers: np.ndarray, block: int) -> np.ndarray:
    height, width, _ = pixels.shape
    m = multipliers.repeat(1 << block, axis=0).repeat(1 << block, axis=1)[:height, :width].view(np.int8).astype(int)
    signed = pixels.view(np.int8).astype(int)
    out = pixels.astype(int)
    green = signed[:, :, GREEN]
    red = (out[:, :, RED] + (m[:, :, BLUE] * green >> 5)) & 255
    blue = out[:, :, BLUE] + (m[:, :, GREEN] * green >> 5) + (m[:, :, RED] * np.where(red > 127, red - 256, red) >> 5)
    out[:, :, RED], out[:, :, BLUE] = red, blue & 255
    return out.astype(np.uint8)


def _unindex(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """Pixels of a row are bundled into the green channel, 8, 4 or 2 at a time, if the palette is small. Indices outside it are transparent black."""
    size = len(palette)
    bits = 1 if size <= 2 else 2 if size <= 4 else 4 if size <= 16 else 8
    green = pixels[:, :, GREEN]
    index = np.stack([green >> s & ((1 << bits) - 1) for s in range(0, 8, bits)], axis=2).reshape(len(green), -1)[:, :width]
    return np.concatenate([palette, np.zeros((256 - size, 4), np.uint8)])[index]


def decode(data: bytes) -> np.ndarray:
    """uint8[height, width, 4] as red, green, blue, alpha of a lossless file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("it isn't a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("it has no lossless image")
        at += 8 + (n := struct.unpack_from("<I", data, at + 4)[0]) + (n & 1)
    n = struct.unpack_from("<I", data, at + 4)[0]
    r = _Reader(data[at + 8 : at + 8 + n])
    if r.get(8) != 0x2F:
        raise ValueError("it has no lossless image")
    width, height, alpha, version = r.get(14) + 1, r.get(14) + 1, r.get(1), r.get(3)
    if version:
        raise ValueError("its version isn't known")
    undo, seen, inner = [], set(), width
    while r.get(1):
        kind = r.get(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind < 2:
            block = r.get(3) + 2
            image = _read_image(r, (inner + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
            undo.append((lambda p, i=image, b=block: _unpredict(p, i[:, :, GREEN], b)) if kind == 0 else (lambda p, i=image, b=block: _uncross(p, i, b)))
        elif kind == 2:
            undo.append(_add_green)
        else:
            size = r.get(8) + 1
            palette = np.cumsum(_read_image(r, size, 1, False)[0].astype(int), axis=0).astype(np.uint8)
            undo.append(lambda p, t=palette, w=inner: _unindex(p, t, w))
            inner = -(-inner * (1 if size <= 2 else 2 if size <= 4 else 4 if size <= 16 else 8) // 8) if size <= 16 else inner
    pixels = _read_image(r, inner, height, True)
    for f in reversed(undo):
        pixels = f(pixels)
    if not alpha:
        pixels = pixels.copy()
        pixels[:, :, ALPHA] = 255
    return pixels


def file_size(data: bytes, at: int = 0) -> int:
    """Bytes of the file that begins there."""
    if data[at : at + 4] != b"RIFF" or len(data) < at + 8:
        raise ValueError("it isn't a WebP file")
    return 8 + struct.unpack_from("<I", data, at + 4)[0]
