"""Round trips through streams that a plain encoder of this file writes: all transforms, back-references, caches and code forms."""

import heapq
import random

import numpy as np
import pytest

from skymatch.llm import media, webp


class Bits:
    def __init__(self):
        self.out = []

    def put(self, value, count):
        self.out += [value >> i & 1 for i in range(count)]

    def bytes(self):
        return np.packbits(np.array(self.out, np.uint8), bitorder="little").tobytes()


def huffman(counts):
    """Code lengths of at most 15 bits."""
    lengths = [0] * len(counts)
    heap = [(c, i, [i]) for i, c in enumerate(counts) if c]
    if len(heap) == 1:
        lengths[heap[0][1]] = 1
        return lengths
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            lengths[i] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    assert max(lengths) <= 15
    return lengths


def canonical(lengths):
    codes, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        codes[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
        code += 1
    if len(codes) == 1:
        codes = {s: (0, 0) for s in codes}
    return codes


def put_code(bits, lengths):
    """A normal code whose lengths are run-length coded."""
    tokens, i = [], 0
    while i < len(lengths):
        j = i
        while j < len(lengths) and lengths[j] == lengths[i]:
            j += 1
        run = j - i
        if lengths[i] == 0 and run >= 11:
            n = min(run, 138)
            tokens.append((18, n - 11, 7))
        elif lengths[i] == 0 and run >= 3:
            n = min(run, 10)
            tokens.append((17, n - 3, 3))
        elif lengths[i] and run >= 4:
            tokens.append((lengths[i], 0, 0))
            n = min(run - 1, 6)
            tokens.append((16, n - 3, 2))
            n += 1
        else:
            tokens.append((lengths[i], 0, 0))
            n = 1
        i += n
    counts = [0] * 19
    for t in tokens:
        counts[t[0]] += 1
    first = huffman(counts)
    bits.put(0, 1)
    bits.put(15, 4)
    for s in webp.CODE_LENGTH_ORDER:
        bits.put(first[s], 3)
    bits.put(0, 1)
    codes = canonical(first)
    for s, extra, n in tokens:
        bits.put(*codes[s])
        bits.put(extra, n)
    return canonical(lengths)


def prefix(v):
    if v <= 4:
        return v - 1, 0, 0
    n = v - 1
    h = n.bit_length() - 1
    return 2 * h + (n >> (h - 1) & 1), n & ((1 << (h - 1)) - 1), h - 1


def tokens_of(pixels, width, cache_bits, references):
    """Literals, back-references and cache hits of a list of (a, r, g, b)."""
    out, cache, i = [], {}, 0
    key = lambda p: (((p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]) * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)) if cache_bits else None
    while i < len(pixels):
        best = (0, 0)
        for d in (1, width, width + 1, 7) if references else ():
            n = 0
            while d <= i and i + n < len(pixels) and pixels[i + n] == pixels[i + n - d] and n < 4096:
                n += 1
            best = max(best, (n, -d))
        if best[0] >= 3:
            n, d = best[0], -best[1]
            code = {width: 1, 1: 2}.get(d, d + 120)
            out.append(("copy", n, code, i))
            for p in pixels[i : i + n]:
                cache[key(p)] = p
            i += n
            continue
        p = pixels[i]
        out.append(("hit", key(p), 0, i) if cache_bits and cache.get(key(p)) == p else ("pixel", p, 0, i))
        cache[key(p)] = p
        i += 1
    return out


def put_image(bits, argb, main, cache_bits=0, references=False, groups=1, block=2):
    height, width, _ = argb.shape
    flat = [tuple(int(v) for v in p) for p in argb.reshape(-1, 4)]
    bits.put(int(cache_bits > 0), 1)
    if cache_bits:
        bits.put(cache_bits, 4)
    group = np.zeros((height, width), int)
    if main:
        bits.put(int(groups > 1), 1)
        if groups > 1:
            r = np.random.default_rng(1)
            small = r.integers(0, groups, ((height + (1 << block) - 1) >> block, (width + (1 << block) - 1) >> block))
            small.flat[0] = groups - 1
            bits.put(block - 2, 3)
            image = np.zeros((*small.shape, 4), int)
            image[:, :, 2] = small
            put_image(bits, image, False)
            group = small.repeat(1 << block, 0).repeat(1 << block, 1)[:height, :width]
    tokens = tokens_of(flat, width, cache_bits, references)
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    counts = [[[0] * n for n in sizes] for _ in range(groups)]
    g_of = [int(group.flat[t[3]]) for t in tokens]
    for t, g in zip(tokens, g_of):
        c = counts[g]
        if t[0] == "pixel":
            a, r_, gr, b = t[1]
            for k, v in ((0, gr), (1, r_), (2, b), (3, a)):
                c[k][v] += 1
        elif t[0] == "hit":
            c[0][280 + t[1]] += 1
        else:
            c[0][256 + prefix(t[1])[0]] += 1
            c[4][prefix(t[2])[0]] += 1
    codes = []
    for c in counts:
        mine = []
        for k in c:
            if not any(k):
                k[0] = 1
            if sum(v > 0 for v in k) == 1 and k.index(max(k)) < 256:  # simple codes
                s = k.index(max(k))
                bits.put(1, 1)
                bits.put(0, 1)
                bits.put(1, 1)
                bits.put(s, 8)
                mine.append({s: (0, 0)})
            elif sum(v > 0 for v in k) == 2 and max(i for i, v in enumerate(k) if v) < 256:
                s, t = (i for i, v in enumerate(k) if v)
                bits.put(1, 1)
                bits.put(1, 1)
                bits.put(1, 1)
                bits.put(s, 8)
                bits.put(t, 8)
                mine.append(canonical([int(i in (s, t)) for i in range(len(k))]))
            else:
                if sum(v > 0 for v in k) == 1:
                    k[0] += 1
                mine.append(put_code(bits, huffman(k)))
        codes.append(mine)
    for t, g in zip(tokens, g_of):
        c = codes[g]
        if t[0] == "pixel":
            a, r_, gr, b = t[1]
            for k, v in ((0, gr), (1, r_), (2, b), (3, a)):
                bits.put(*c[k][v])
        elif t[0] == "hit":
            bits.put(*c[0][280 + t[1]])
        else:
            for k, v in ((0, t[1]), (4, t[2])):
                p, extra, n = prefix(v)
                bits.put(*c[k][p + (256 if k == 0 else 0)])
                bits.put(extra, n)


def predict(mode, left, top, top_left, top_right):
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [a + b - c for a, b, c in zip(left, top, top_left)]
        pl, pt = sum(abs(x - y) for x, y in zip(p, left)), sum(abs(x - y) for x, y in zip(p, top))
        return left if pl < pt else top
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(left, top, top_left)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(avg(left, top), top_left)]
    return [
        [255, 0, 0, 0], left, top, top_right, top_left, avg(avg(left, top_right), top), avg(left, top_left), avg(left, top), avg(top_left, top), avg(top, top_right), avg(avg(left, top_left), avg(top, top_right)),
    ][mode]


def header(bits, width, height):
    bits.put(0x2F, 8)
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(1, 1)
    bits.put(0, 3)


def wrapped(bits):
    data = bits.bytes()
    body = b"WEBP" + b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def picture(height, width, colours, seed):
    r = np.random.default_rng(seed)
    palette = r.integers(0, 256, (colours, 4))
    argb = palette[r.integers(0, colours, (height, width))]
    argb[height // 2 :] = argb[: height - height // 2]  # something to refer back to
    return argb


def rgba(argb):
    return argb[:, :, [1, 2, 3, 0]].astype(np.uint8)


@pytest.mark.parametrize("cache_bits", [0, 1, 5, 11])
@pytest.mark.parametrize("references", [False, True])
@pytest.mark.parametrize("groups", [1, 3])
def test_symbols(cache_bits, references, groups):
    for seed, (h, w, colours) in enumerate([(1, 1, 1), (5, 7, 2), (16, 9, 40), (23, 31, 200)]):
        argb = picture(h, w, colours, seed)
        bits = Bits()
        header(bits, w, h)
        bits.put(0, 1)
        put_image(bits, argb, True, cache_bits, references, groups)
        assert (webp.decode(wrapped(bits)) == rgba(argb)).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    argb = picture(11, 13, 60, mode)
    h, w, _ = argb.shape
    residual = np.zeros_like(argb)
    for y in range(h):
        for x in range(w):
            at = lambda i, j: [int(v) for v in argb[i, j]]
            if y == 0 and x == 0:
                p = [255, 0, 0, 0]
            elif y == 0:
                p = at(0, x - 1)
            elif x == 0:
                p = at(y - 1, 0)
            else:
                p = predict(mode, at(y, x - 1), at(y - 1, x), at(y - 1, x - 1), at(y - 1, x + 1) if x + 1 < w else at(y, 0))
            residual[y, x] = [(int(v) - q) & 255 for v, q in zip(argb[y, x], p)]
    bits = Bits()
    header(bits, w, h)
    bits.put(1, 1)
    bits.put(0, 2)
    bits.put(0, 3)  # blocks of 4
    modes = np.zeros(((h + 3) // 4, (w + 3) // 4, 4), int)
    modes[:, :, 2] = mode
    put_image(bits, modes, False)
    bits.put(0, 1)
    put_image(bits, residual, True)
    assert (webp.decode(wrapped(bits)) == rgba(argb)).all()


def test_cross_colour_and_subtract_green():
    argb = picture(9, 10, 80, 3)
    h, w, _ = argb.shape
    r = np.random.default_rng(4)
    m = r.integers(0, 256, ((h + 3) // 4, (w + 3) // 4, 4))
    s = lambda v: int(v) - 256 if v > 127 else int(v)
    work = argb.copy()
    work[:, :, 1] = (work[:, :, 1] - work[:, :, 2]) & 255
    work[:, :, 3] = (work[:, :, 3] - work[:, :, 2]) & 255
    out = work.copy()
    for y in range(h):
        for x in range(w):
            _, red_to_blue, green_to_blue, green_to_red = m[y // 4, x // 4]
            _, red, green, blue = work[y, x]
            out[y, x, 1] = (int(red) - (s(green_to_red) * s(green) >> 5)) & 255
            out[y, x, 3] = (int(blue) - (s(green_to_blue) * s(green) >> 5) - (s(red_to_blue) * s(red) >> 5)) & 255
    bits = Bits()
    header(bits, w, h)
    bits.put(1, 1)
    bits.put(2, 2)
    bits.put(1, 1)
    bits.put(1, 2)
    bits.put(0, 3)
    put_image(bits, m, False)
    bits.put(0, 1)
    put_image(bits, out, True)
    assert (webp.decode(wrapped(bits)) == rgba(argb)).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 100])
def test_palette(colours):
    r = np.random.default_rng(colours)
    palette = r.integers(0, 256, (colours, 4))
    index = r.integers(0, colours, (7, 19))
    argb = palette[index]
    n = 8 if colours <= 2 else 4 if colours <= 4 else 2 if colours <= 16 else 1
    width = -(-19 // n)
    green = np.zeros((7, width), int)
    for x in range(19):
        green[:, x // n] |= index[:, x] << (8 // n * (x % n))
    image = np.zeros((7, width, 4), int)
    image[:, :, 2] = green
    bits = Bits()
    header(bits, 19, 7)
    bits.put(1, 1)
    bits.put(3, 2)
    bits.put(colours - 1, 8)
    put_image(bits, np.diff(palette, axis=0, prepend=np.zeros((1, 4), int))[None] & 255, False)
    bits.put(0, 1)
    put_image(bits, image, True)
    assert (webp.decode(wrapped(bits)) == rgba(argb)).all()


def test_own_encoder():
    r = np.random.default_rng(0)
    for high in (1, 2, 3, 5, 17, 64, 65, 256):
        for shape in ((1, 1), (3, 16), (40, 7), (90, 64)):
            p = r.integers(0, high, (*shape, 4)).astype(np.uint8)
            assert (webp.decode(webp.encode(p)) == p).all()
            p[:, :, 3] = 255
            assert (webp.decode(webp.encode(p)) == p).all()
            grey = webp.decode(webp.encode(p[:, :, 0]))
            assert (grey[:, :, :3] == p[:, :, :1]).all() and (grey[:, :, 3] == 255).all()
            p[:, :, [0, 2]] = p[:, :, [1]] + np.arange(2, dtype=np.uint8)  # green is worth subtracting
            assert (webp.decode(webp.encode(p)) == p).all()
    ramp = np.add.outer(np.arange(50), np.arange(64) ** 2).astype(np.uint8)  # rows are worth predicting
    assert (webp.decode(webp.encode(ramp))[:, :, 1] == ramp).all()
    skewed = np.repeat(np.arange(40), np.minimum(2 ** np.arange(40) // 8 + 1, 4000)).astype(np.uint8)  # codes that would be too long
    skewed = r.permutation(skewed[: len(skewed) // 64 * 64]).reshape(-1, 64)
    assert (webp.decode(webp.encode(skewed))[:, :, 1] == skewed).all()
    for period in (1, 2, 3, 64, 65, 700, 5000):  # long stretches, also overlapping themselves
        p = np.resize(r.integers(0, 200, period), 64 * 300).astype(np.uint8).reshape(-1, 64)
        assert (webp.decode(webp.encode(p))[:, :, 1] == p).all() and len(webp.encode(p)) < 2 * period + 200


def test_documents_pass_by_the_decoder(sf, monkeypatch):
    """Most texts are stored with prefix codes of several lengths, back-references and a transform, in well below 55% of their bytes."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    seen = {"codes": 0, "copies": 0, "green": 0, "stored": 0, "bytes": 0}
    read, add = webp._read_greens, webp._add_green

    def reading(r, width, height, codes):
        seen["codes"] += codes[0].lone is None and len(set(codes[0].lengths[codes[0].symbols].tolist())) > 1
        seen["copies"] += bool(codes[0].symbols[-1] >= webp.LITERALS)
        return read(r, width, height, codes)

    def adding(pixels):
        seen["green"] += 1
        return add(pixels)

    monkeypatch.setattr(webp, "_read_greens", reading)
    monkeypatch.setattr(webp, "_add_green", adding)
    for t in texts:
        payload = media.padded(t.encode())
        stored = media.to_media(payload)
        assert media.to_pixels(stored).tobytes() == payload
        seen["stored"], seen["bytes"] = seen["stored"] + len(stored), seen["bytes"] + len(payload)
    assert min(seen["codes"], seen["green"]) >= 0.95 * len(texts) and seen["copies"] >= 0.9 * len(texts)
    assert seen["stored"] < 0.55 * seen["bytes"]


def test_refusals():
    with pytest.raises(ValueError):
        webp.encode(np.zeros((1, webp.MAX_SIDE + 1, 4), np.uint8))


def test_damage_is_an_error():
    good = webp.encode(np.arange(256, dtype=np.uint8).reshape(4, 16, 4))
    for bad in (b"", b"RIFF", good[:12], good[:30], b"RIFF" + good[4:8] + b"WEBQ" + good[12:], good[:20] + b"\0" + good[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    rnd = random.Random(3)
    for _ in range(200):
        cut = bytearray(good)
        cut[rnd.randrange(20, len(cut))] ^= 1 << rnd.randrange(8)
        try:
            webp.decode(bytes(cut))
        except ValueError:
            pass


def test_media_of_any_length():
    for n in (0, 1, 63, 64, 65, 5000, media.UNIT * webp.MAX_SIDE, media.UNIT * webp.MAX_SIDE + 1):
        payload = media.padded(bytes(i * 7 % 251 for i in range(n)))
        assert len(payload) % 64 == 0 and payload
        assert media.to_pixels(media.to_media(payload)).tobytes() == payload


def test_round_trip(spark):
    import hashlib
    import zlib

    rows = [(1, "abc", 5), (2, None, 5), (3, "", 6), (4, "abc", 7), (5, "é" * 100_000, 8), (None, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    out = {r["doc_id"]: r for r in media.round_trip(df).collect()}
    assert len(out) == 6 and out[1]["media_sha256"] == out[4]["media_sha256"]
    for i, text, _ in rows:
        raw = (text or "").encode()
        payload = media.padded(raw)
        got = out[i]
        assert (got["n_bytes"], got["payload_bytes"], got["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert got["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got["media_bytes"] == len(media.to_media(payload))
    assert media.round_trip(df.limit(0)).count() == 0
    both = media.decode_column(media.encode_column(df, media="m"), media="m").collect()
    assert all(bytes(r["pixels"]["samples"]).rstrip(b"\0") == (r["text"] or "").encode() for r in both)


def test_walks():
    """Leaps of eight and what lies between give the places that single steps give."""
    r = np.random.default_rng(0)
    for n in (1, 2, 7, 8, 9, 100, 3000):
        for most in (1, 2, 9, 200):
            for kind in (np.int32, np.int64):
                next_ = (np.arange(n) + r.integers(1, most + 1, n)).astype(kind)
                start, stop = int(r.integers(0, n)), int(r.integers(0, n + 1))
                want, p = [], start
                while p < stop:
                    want.append(p)
                    p = int(next_[p])
                assert webp.walked(next_, start, stop).tolist() == want
