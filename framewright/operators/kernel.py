"""The numpy kernel that encodes one whole frame: the throughput form of the codec's operators.

Everything is done for all slices of a frame together: the transform is two matrix products, the
bit cost of a quantizer is a few passes over the coefficients that survive it, and all symbols of
a frame are packed at once.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from ..functions.tables import BASIS, CHROMA, COLOR, DC_BOOKS, DC_OFFSET, FIRST_DC_BOOK, LEVEL_BOOKS, LUMA, RUN_BOOKS, SCAN, SCORE_LIMIT, SLICE_MBS, Config

_M = np.array(BASIS, dtype=np.float64)
_SCAN = np.array(SCAN)
_EVEN = np.isin(np.arange(8), (0, 4))
#: More than any run (32 blocks of 63 places) and any level (coefficients are below 32768, weights 4 at least).
RUNS, LEVELS = 2048, 8192


def to_planes(rgba: np.ndarray, config: Config) -> list[np.ndarray]:
    """(height, width, 4) bytes to planes Y, Cb, Cr and, with full chroma, A; 10-bit samples."""

    def plane(pixels: list[np.ndarray], name: str) -> np.ndarray:
        r, g, b, offset, low, high = COLOR[config.color_range][name]
        value = pixels[0] * np.int32(r)
        value += pixels[1] * np.int32(g)
        value += pixels[2] * np.int32(b)
        value += 2048
        value >>= 12
        value += offset
        return np.clip(value, low, high, out=value)

    rgb = [np.ascontiguousarray(rgba[:, :, k]).astype(np.int32) for k in range(3)]
    if config.is_444:
        alpha = np.minimum(1023, (rgba[:, :, 3].astype(np.int32) * 16430 + 2048) >> 12)
        return [plane(rgb, "y"), plane(rgb, "cb"), plane(rgb, "cr"), alpha]
    pairs = []
    for x in rgb:
        even, odd = x[:, 0::2], x[:, 1::2]
        if odd.shape[1] < even.shape[1]:  # an odd last column pairs with itself
            odd = np.concatenate([odd, even[:, -1:]], axis=1)
        pairs.append((even + odd) >> 1)
    return [plane(rgb, "y"), plane(pairs, "cb"), plane(pairs, "cr")]


def pad(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """Repeats the last column and the last row."""
    return np.pad(plane, ((0, height - plane.shape[0]), (0, width - plane.shape[1])), mode="edge")


def tiles(plane: np.ndarray, kind: str) -> np.ndarray:
    """(macroblock rows, macroblocks, blocks, 8, 8); kind: luma, half (two blocks), or full (by columns)."""
    width = 8 if kind == "half" else 16
    mbs = plane.reshape(plane.shape[0] // 16, 2, 8, plane.shape[1] // width, width // 8, 8)  # row, by, y, mb, bx, x
    order = (0, 3, 4, 1, 2, 5) if kind == "full" else (0, 3, 1, 4, 2, 5)
    blocks = mbs.transpose(order)
    return blocks.reshape(blocks.shape[0], blocks.shape[1], -1, 8, 8)


def transform(blocks: np.ndarray) -> np.ndarray:
    """Integer cosine transform of (..., 8, 8) samples: two exact products, each with one rounding shift.

    The shifts are powers of two in the matrices, so the products stay exact in double precision.
    The first pass keeps one more bit: its two plain sums are doubled, the others lose 12 bits.
    """

    def turn(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """The last axis transformed and made the one before."""
        y = x.reshape(-1, 8) @ matrix.T
        y += 0.5
        np.floor(y, out=y)
        return np.ascontiguousarray(y.reshape(-1, 8, 8).swapaxes(1, 2))

    first = turn(blocks.astype(np.float64), _M * np.where(_EVEN, 2.0, 2.0**-12)[:, None])
    return turn(first, _M * np.where(_EVEN, 2.0**-2, 2.0**-15)[:, None]).astype(np.int32).reshape(blocks.shape)


@cache
def _books() -> dict[str, np.ndarray]:
    return {"run": np.array(RUN_BOOKS), "level": np.array(LEVEL_BOOKS), "dc": np.array(DC_BOOKS)}


def codeword(book: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, bits) of values in Rice and exponential-Golomb hybrid books."""
    switch, rice, exp = (book & 3) + 1, book >> 5, (book >> 2) & 7
    limit = switch << rice
    large = value >= limit
    v = np.where(large, value - limit + (1 << exp), 1)
    e = np.frexp(v.astype(np.float64))[1] - 1
    return np.where(large, v, (1 << rice) | (value & ((1 << rice) - 1))), np.where(large, 2 * e - exp + switch + 1, (value >> rice) + 1 + rice)


@cache
def _symbols() -> tuple[np.ndarray, ...]:
    """Codes and lengths by context and run, and by context and level, each as one long table."""
    books = _books()
    run = [codeword(np.int64(b), np.arange(RUNS)) for b in books["run"]]
    level = [codeword(np.int64(b), np.maximum(np.arange(LEVELS + 1) - 1, 0)) for b in books["level"]]
    level = [(c[:LEVELS], n[:LEVELS]) for c, n in level]
    return tuple(np.concatenate([x[k] for x in y]).astype(kind) for y in (run, level) for k, kind in ((0, np.uint64), (1, np.uint8)))


def sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of neighbouring values, ``count`` of them each."""
    out = np.zeros(len(count), np.int64)
    some = np.flatnonzero(count)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(count) - count)[some], dtype=np.int64)
    return out


class Levels:
    """What a frame's plane has left at some quantizer, in coding order: the place in the slice, the
    quotient by the matrix and the matrix's weight of each coefficient, and how many each slice has."""

    def __init__(self, pos: np.ndarray, level: np.ndarray, weight: np.ndarray, count: np.ndarray):
        self.pos, self.level, self.weight, self.count = pos, level, weight, count

    def at(self, places: np.ndarray) -> Levels:
        """Those at some places; slices without any keep a count of 0."""
        ends = np.searchsorted(places, np.cumsum(self.count))
        return Levels(self.pos[places], self.level[places], self.weight[places], np.diff(ends, prepend=0))

    def of(self, slices: np.ndarray) -> Levels:
        """Some slices' own."""
        got = self.at(np.flatnonzero(np.repeat(slices, self.count)))
        got.count = got.count[slices]
        return got

    def over(self, q: int) -> Levels:
        """Those that survive a quantizer."""
        return self.at(np.flatnonzero(self.level >= q))

    def under(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of those that survive their slice's quantizer, and their levels there: a quotient's quotient is the quotient by the product."""
        scale = np.repeat(q.astype(np.int16), self.count)
        places = np.flatnonzero(self.level >= scale)
        level = self.level[places] + np.float32(0.5)  # below 8192: a half is enough to be exact
        level /= scale[places]
        return places, level.astype(np.int16)

    def contexts(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each one's run and level stand in the tables of symbols."""
        begin = (np.cumsum(self.count) - self.count)[self.count > 0]
        run = np.empty_like(self.pos)
        np.subtract(self.pos[1:], self.pos[:-1], out=run[1:])
        run -= 1
        run[begin] = self.pos[begin]
        runs, levels = np.empty_like(run), np.empty(len(run), np.int32)
        np.minimum(run[:-1], 15, out=runs[1:])
        np.minimum(level[:-1], 9, out=levels[1:])
        runs[begin], levels[begin] = 4, 2
        runs *= RUNS  # 16 times 2048 places: 16 bits are enough
        runs += run
        levels *= LEVELS
        levels += level
        return runs, levels


class Plane:
    """One plane's coefficients of a frame, by slice; quantized and coded for any quantizers of the slices."""

    def __init__(self, blocks: np.ndarray, matrix: tuple[int, ...]):
        """blocks: (macroblock rows, macroblocks, blocks, 8, 8) coefficients."""
        rows, mbs, per, _, _ = blocks.shape
        self.matrix = np.array(matrix, dtype=np.int32)
        self.slices = -(-mbs // SLICE_MBS)
        self.total = rows * self.slices
        most = SLICE_MBS * per
        short = self.slices * SLICE_MBS - mbs  # the last slice of a row may have fewer macroblocks
        flat = blocks.reshape(rows, mbs * per, 64)
        whole = np.pad(flat, ((0, 0), (0, short * per), (0, 0))) if short else flat
        whole = whole.reshape(self.total, most, 64)
        blocks_of = np.full(self.slices, most)
        blocks_of[-1] -= short * per
        self.blocks = np.tile(blocks_of, rows)
        self.dc = (flat[:, :, 0] - DC_OFFSET).ravel()
        self.dc_first = np.zeros(len(self.dc), bool)
        self.dc_first[np.cumsum(self.blocks) - self.blocks] = True
        # AC in scan order: the position in the slice goes over blocks first, then along the scan
        signed = np.ascontiguousarray(whole[:, :, _SCAN[1:]].transpose(0, 2, 1))
        size = np.abs(signed)
        self.sizes = size.sum(axis=(1, 2), dtype=np.int64)
        weight = self.matrix[_SCAN[1:]]
        level = ((size + np.float32(0.5)) / weight[:, None].astype(np.float32)).astype(np.int16)  # exact, as below 8192
        count = np.count_nonzero(level, axis=(1, 2))
        at = np.flatnonzero(level)
        pos = (at - np.repeat(np.arange(self.total) * (63 * most), count)).astype(np.int16)
        along = pos // np.int16(most)
        if short:
            pos -= along * np.repeat(most - self.blocks, count).astype(np.int16)
        # no quantizer is below 1: what the matrix alone takes away never comes back
        self.all, self.minus = Levels(pos, level.ravel()[at], weight.astype(np.int16)[along], count), signed.ravel()[at] < 0

    def dc_symbols(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Books and values of the DC symbols, and each block's remainder, for quantizers by slice."""
        scale = np.repeat(np.maximum(1, self.matrix[0] * q), self.blocks)
        level = np.sign(self.dc) * (np.abs(self.dc) // scale)
        before = np.r_[0, level[:-1]]
        delta = np.where(self.dc_first, level, level - before)
        raw_sign = np.where(self.dc_first, 0, delta < 0)
        flip = np.r_[0, raw_sign[:-1]].astype(bool) & ~self.dc_first
        delta = np.where(flip, -delta, delta)
        code = np.where(delta < 0, -2 * delta - 1, 2 * delta)
        prior = np.r_[0, code[:-1]]
        second = np.r_[False, self.dc_first[:-1]]
        book = np.where(self.dc_first, FIRST_DC_BOOK, _books()["dc"][np.where(second, 5, np.minimum(prior, 6))])
        return book, code, np.abs(self.dc) % scale

    def cost(self, q: np.ndarray, left: Levels, level: np.ndarray, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bits, in whole bytes, and the sum of remainders of each slice, given what survives; of ``some`` slices alone."""
        book, code, rest = self.dc_symbols(q)
        bits, error = sums(codeword(book, code)[1], self.blocks), sums(rest, self.blocks)
        sizes = self.sizes
        if some is not None:
            bits, error, q, sizes = bits[some], error[some], q[some], sizes[some]
        runs, levels = left.contexts(level)
        _, run_bits, _, level_bits = _symbols()
        bits += sums(run_bits[runs] + level_bits[levels], left.count) + left.count
        error += sizes - q * sums(np.multiply(level, left.weight, dtype=np.int32), left.count)
        return (bits + 7) // 8 * 8, error

    def code(self, q: np.ndarray) -> list[memoryview]:
        """The coded bytes of each slice."""
        book, code, _ = self.dc_symbols(q)
        dc, dc_bits = codeword(book, code)
        places, level = self.all.under(q)
        left = self.all.at(places)
        runs, levels = left.contexts(level)
        run_code, run_bits, level_code, level_bits = _symbols()
        more = level_bits[levels] + np.int32(1)
        # a coefficient's run, level and sign are one code, of 60 bits at most
        ac = run_code[runs] << more.astype(np.uint64) | level_code[levels] << np.uint64(1) | self.minus[places]
        # a slice's DC symbols come first
        both, begin = self.blocks + left.count, np.cumsum(self.blocks + left.count) - self.blocks - left.count
        codes, bits = np.empty(both.sum(), np.uint64), np.empty(both.sum(), np.uint8)
        of_dc = np.arange(len(dc)) + np.repeat(begin - np.cumsum(self.blocks) + self.blocks, self.blocks)
        of_ac = np.arange(len(ac)) + np.repeat(begin + self.blocks - np.cumsum(left.count) + left.count, left.count)
        codes[of_dc], codes[of_ac], bits[of_dc], bits[of_ac] = dc, ac, dc_bits, run_bits[runs] + more
        return pack(codes, bits, both)


def pack(codes: np.ndarray, bits: np.ndarray, count: np.ndarray) -> list[memoryview]:
    """Codes of up to 64 bits, most significant first, end to end; pieces of ``count`` codes each end at a whole byte."""
    at = np.cumsum(bits, dtype=np.int64)
    size = np.diff(np.r_[0, at][np.cumsum(count)], prepend=0)
    room = (size + 7) // 8 * 8
    start = np.cumsum(room) - room
    at -= bits
    at += np.repeat(start - np.cumsum(size) + size, count)
    words = np.zeros(int(room.sum()) // 64 + 2, np.uint64)
    if len(codes):
        free = 64 - (at & 63).astype(np.int8) - bits.astype(np.int8)
        at >>= 6
        over = np.flatnonzero(free < 0)
        value = codes << np.maximum(free, 0).astype(np.uint64)
        value[over] = codes[over] >> (-free[over]).astype(np.uint64)
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        words[at[new]] = np.bitwise_or.reduceat(value, new)
        words[at[over] + 1] |= codes[over] << (64 + free[over].astype(np.int64)).astype(np.uint64)  # one code at most goes over each edge
    data = memoryview(words.astype(">u8").tobytes())
    return [data[a : a + n] for a, n in zip((start // 8).tolist(), (room // 8).tolist(), strict=True)]


def pack_symbols(codes: np.ndarray, bits: np.ndarray) -> bytes:
    """One piece of coded symbols."""
    return bytes(pack(np.asarray(codes, np.int64).astype(np.uint64), np.asarray(bits, np.int64), np.array([len(codes)]))[0])


@cache
def _differences() -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of all differences of 16-bit samples."""
    diff = np.arange(1 << 16)
    signed = np.where(diff >= 0x10000 - 64, diff - 0x10000, diff)
    long = (signed < -64) | (signed > 64) | (signed == 0)
    return np.where(long, 1 << 16 | diff, (np.abs(signed) - 1) << 1 | (signed < 0)).astype(np.uint64), np.where(long, 17, 8).astype(np.uint8)


def alpha_code(pixels: np.ndarray, count: np.ndarray) -> list[memoryview]:
    """Slices' alpha: 16-bit samples in raster order, ``count`` of each slice, as differences and runs."""
    pixels = pixels.astype(np.uint16)
    begin = np.cumsum(count) - count
    before = np.empty_like(pixels)
    before[1:] = pixels[:-1]
    before[begin] = 0xFFFF
    change = pixels != before
    change[begin] = True
    at = np.flatnonzero(change)
    codes, bits = _differences()
    diff = pixels[at] - before[at]  # modulo 65536
    run = np.diff(at, append=len(pixels)) - 1
    run_bits = np.ones(len(run), np.uint8)
    run_bits[run > 0] = 5
    run_bits[run > 15] = 16
    run[run == 0] = 1
    # a value and its run are one code
    code = codes[diff] << run_bits.astype(np.uint64) | run.astype(np.uint64)
    return pack(code, bits[diff] + run_bits, np.diff(np.searchsorted(at, begin), append=len(at)))


class Frame:
    """A frame's coefficients, and what follows from them."""

    def __init__(self, rgba: np.ndarray, config: Config):
        self._begin(to_planes(rgba, config), config)

    @classmethod
    def of_planes(cls, planes: list[np.ndarray], config: Config) -> Frame:
        """From planes that are converted already."""
        frame = cls.__new__(cls)
        frame._begin(planes, config)
        return frame

    def _begin(self, planes: list[np.ndarray], config: Config) -> None:
        self.config = config
        width, height = config.mb_width * 16, config.mb_height * 16
        half = width if config.is_444 else width // 2
        padded = [pad(p, half if 0 < i < 3 else width, height) for i, p in enumerate(planes)]
        kind = "full" if config.is_444 else "half"
        self.planes = [Plane(transform(tiles(p, "luma" if i == 0 else kind)), (LUMA if i == 0 else CHROMA)[config.profile]) for i, p in enumerate(padded[:3])]
        self.alpha = padded[3] if config.is_444 else None
        self.mbs = np.minimum(SLICE_MBS, config.mb_width - SLICE_MBS * np.arange(config.slices_per_row))

    def cost(self, q: np.ndarray, own: list[Levels] | None = None, some: np.ndarray | None = None, budget: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bits with the header, and error, of each slice at its quantizer; own: levels that hold all that survive.

        With ``some`` for these slices alone; with a ``budget`` for them, a slice that is beyond it by
        the number of its symbols alone isn't worked out: its bits are that bound.
        """
        q_of = q if some is None else q[some]
        head = 64 if self.config.is_444 else 48
        got = []
        for x in own if own else (p.all for p in self.planes):
            places, level = x.under(q_of)
            got.append((x.at(places), level))
        beyond = None
        if budget is not None:
            least = head + 3 * sum(left.count for left, _ in got)  # a run, a level and a sign have a bit each
            beyond = (least > budget) & (q_of < 127)
            if beyond.any():
                got = [self._without(left, level, beyond) for left, level in got]
        parts = [p.cost(q, left, level, some) for p, (left, level) in zip(self.planes, got, strict=True)]
        bits, error = sum(b for b, _ in parts) + head, sum(e for _, e in parts)
        return (bits if beyond is None else np.where(beyond, least, bits)), error

    @staticmethod
    def _without(left: Levels, level: np.ndarray, slices: np.ndarray) -> tuple[Levels, np.ndarray]:
        places = np.flatnonzero(~np.repeat(slices, left.count))
        return left.at(places), level[places]

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slices, states) bits, scores and quantizers: the regular quantizers and one beyond them."""
        c, n = self.config, self.planes[0].total
        regular, own = [], [p.all for p in self.planes]
        for q in range(c.min_q, c.max_q + 1):
            own = [x.over(q) for x in own]  # what a quantizer drops, larger ones drop too
            parts = [p.cost(np.full(n, q), x, x.level // np.int16(q)) for p, x in zip(self.planes, own, strict=True)]
            regular.append((sum(b for b, _ in parts) + (64 if c.is_444 else 48), sum(e for _, e in parts)))
        bits = np.stack([b for b, _ in regular], axis=1)
        score = np.where(bits > 65000 * 8, SCORE_LIMIT, np.stack([e for _, e in regular], axis=1))
        budget = np.tile(self.mbs, n // len(self.mbs)) * c.bits_per_mb
        over_q, over_bits, over_score = np.full(n, c.max_q), bits[:, -1].copy(), score[:, -1] + 1
        # bits need not fall with the quantizer: the probes of a binary search are part of the result
        low, high = np.full(n, c.max_q + 1), np.full(n, 127)
        seek = bits[:, -1] > budget
        over_q[seek], over_bits[seek], over_score[seek] = -1, 0, 0
        before = np.ones(n, bool)
        while seek.any():
            q = np.where(seek, low + (high - low) // 2, c.max_q)
            if (seek != before).any():
                own, before = [x.of(seek[before]) for x in own], seek.copy()
            b, e = (np.zeros(n, np.int64) for _ in range(2))
            b[seek], e[seek] = self.cost(q, own, seek, budget[seek])
            fits = seek & (b <= budget)
            last = seek & ~fits & (q == 127)
            over_q[fits], over_q[last] = q[fits], 128
            over_bits[fits | last], over_score[fits | last] = b[fits | last], e[fits | last]
            high[fits] = q[fits] - 1
            low[seek & ~fits] = q[seek & ~fits] + 1
            seek &= (low <= high) & ~last
        states = np.tile(np.arange(c.min_q, c.max_q + 1), (n, 1))
        return np.c_[bits, over_bits], np.c_[score, over_score], np.c_[states, over_q]

    def quantizers(self) -> np.ndarray:
        """Of each slice, by the cheapest path through the slices of each macroblock row."""
        bits, score, states = self.candidates()
        c = self.config
        rows, slices, n = c.mb_height, c.slices_per_row, bits.shape[1]
        bits, score = bits.reshape(rows, slices, n), score.reshape(rows, slices, n)
        limit = np.cumsum(self.mbs) * c.bits_per_mb
        at_bits, at_score = np.zeros((rows, n), np.int64), np.zeros((rows, n), np.int64)
        came = np.zeros((rows, slices, n), np.int64)
        for s in range(slices):
            total = at_bits[:, :, None] + bits[:, s, None, :]  # from, to
            error = np.where(total > limit[s], SCORE_LIMIT, score[:, s, None, :])
            new = np.where((at_score[:, :, None] < SCORE_LIMIT) & (error < SCORE_LIMIT), at_score[:, :, None] + error, SCORE_LIMIT)
            # of equal scores the last predecessor counts
            best = n - 1 - new[:, ::-1].argmin(axis=1)
            came[:, s] = best
            at_score = np.take_along_axis(new, best[:, None], axis=1)[:, 0]
            at_bits = np.take_along_axis(total, best[:, None], axis=1)[:, 0]
        state = n - 1 - at_score[:, ::-1].argmin(axis=1)
        out = np.zeros((rows, slices), np.int64)
        for s in range(slices - 1, -1, -1):
            out[:, s] = states.reshape(rows, slices, n)[np.arange(rows), s, state]
            state = came[np.arange(rows), s, state]
        return out.ravel()

    def slices(self, q: np.ndarray) -> list[bytes]:
        """Each slice with its header. A length that its field cannot hold is an error."""
        coded = [p.code(q) for p in self.planes]
        alphas = self.alphas() if self.alpha is not None else [b""] * len(q)
        out = []
        for i, (y, u, v, alpha) in enumerate(zip(*coded, alphas, strict=True)):
            sizes = [len(y), len(u), len(v)] if self.config.is_444 else [len(y), len(u)]
            head = bytes([64 if self.config.is_444 else 48, int(q[i])]) + b"".join(_be(x, 2) for x in sizes)
            data = b"".join((head, y, u, v, alpha))
            _be(len(data), 2)
            out.append(data)
        return out

    def alphas(self) -> list[memoryview]:
        """The coded alpha of each slice."""
        rows, wide = self.config.mb_height, 16 * SLICE_MBS
        short = -self.alpha.shape[1] % wide
        pixels = np.pad(self.alpha, ((0, 0), (0, short))).reshape(rows, 16, -1, wide).transpose(0, 2, 1, 3)
        if short:
            there = np.broadcast_to(np.arange(wide) < 16 * self.mbs[:, None, None], (rows, len(self.mbs), 16, wide))
            pixels = pixels[there]
        pixels = pixels.reshape(-1)
        return alpha_code(pixels << 6 | pixels >> 4, np.tile(256 * self.mbs, rows))

    def packet(self) -> bytes:
        slices = self.slices(self.quantizers())
        return frame_bytes(self.config, slices)


def _be(value: int, size: int) -> bytes:
    return int(value).to_bytes(size, "big")  # raises if it doesn't fit


def picture_header(slices: list[bytes]) -> bytes:
    size = 8 + 2 * len(slices) + sum(map(len, slices))
    return b"\x40" + _be(size, 4) + _be(len(slices), 2) + b"\x30" + b"".join(_be(len(s), 2) for s in slices)


def frame_header(config: Config, size: int) -> bytes:
    full = config.is_444
    flags = (3 if full else 2) << 6
    return (
        _be(size, 4) + b"icpf" + _be(148, 2) + _be(int(full), 2) + b"wasm" + _be(config.width, 2) + _be(config.height, 2)
        + bytes([flags, 0, 1, 1, 1, 2 if full else 0, 0, 3]) + bytes(LUMA[config.profile]) + bytes(CHROMA[config.profile])
    )


def frame_bytes(config: Config, slices: list[bytes]) -> bytes:
    body = picture_header(slices) + b"".join(slices)
    return frame_header(config, 156 + len(body)) + body


def encode(rgba: bytes | np.ndarray, config: Config) -> bytes:
    """A frame's packet from its RGBA bytes."""
    if len(rgba) != config.frame_bytes:
        raise ValueError(f"a frame of {config.width} x {config.height} has {config.frame_bytes} bytes, not {len(rgba)}")
    pixels = np.frombuffer(rgba, np.uint8).reshape(config.height, config.width, 4)
    return Frame(pixels, config).packet()
