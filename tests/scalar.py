"""A frame encoded by plain loops over numbers, one symbol at a time: the check on the kernel."""

from framewright.functions.tables import BASIS, CHROMA, COLOR, DC_BOOKS, FIRST_DC_BOOK, LEVEL_BOOKS, LUMA, RUN_BOOKS, SCAN, SCORE_LIMIT, Config


def planes(rgba: bytes, c: Config) -> list[list[list[int]]]:
    def value(name, r, g, b):
        kr, kg, kb, offset, low, high = COLOR[c.color_range][name]
        return max(low, min(high, ((kr * r + kg * g + kb * b + 2048) >> 12) + offset))

    px = [[tuple(rgba[(y * c.width + x) * 4 :][:4]) for x in range(c.width)] for y in range(c.height)]
    luma = [[value("y", *p[:3]) for p in row] for row in px]
    if c.is_444:
        rest = [[[value(n, *p[:3]) for p in row] for row in px] for n in ("cb", "cr")]
        return [luma, *rest, [[min(1023, (p[3] * 16430 + 2048) >> 12) for p in row] for row in px]]
    out = [luma]
    for n in ("cb", "cr"):
        rows = []
        for row in px:
            pairs = [(row[x], row[min(x + 1, c.width - 1)]) for x in range(0, c.width, 2)]
            rows.append([value(n, *((a + b) // 2 for a, b in zip(p[:3], q[:3], strict=True))) for p, q in pairs])
        out.append(rows)
    return out


def dct(block: list[list[int]]) -> list[int]:
    shift = lambda v, n: (v + (1 << (n - 1))) >> n
    rows = []
    for line in block:
        sums = [sum(m * v for m, v in zip(BASIS[u], line, strict=True)) for u in range(8)]
        rows.append([s * 2 if u % 4 == 0 else shift(s, 12) for u, s in enumerate(sums)])
    out = []
    for u in range(8):
        for k in range(8):
            s = sum(BASIS[u][r] * rows[r][k] for r in range(8))
            out.append(shift(s, 2 if u % 4 == 0 else 15))
    return out


def slice_blocks(plane, kind: str, row: int, first_mb: int, mbs: int) -> list[list[int]]:
    height, width = len(plane), len(plane[0])
    at = lambda y, x: plane[min(y, height - 1)][min(x, width - 1)]
    places = {"luma": [(0, 0), (0, 8), (8, 0), (8, 8)], "half": [(0, 0), (8, 0)], "full": [(0, 0), (8, 0), (0, 8), (8, 8)]}[kind]
    step = 8 if kind == "half" else 16
    return [dct([[at(row * 16 + dy + r, (first_mb + m) * step + dx + k) for k in range(8)] for r in range(8)]) for m in range(mbs) for dy, dx in places]


def word(book: int, value: int) -> str:
    switch, rice, exp = (book & 3) + 1, book >> 5, (book >> 2) & 7
    if value >= switch << rice:
        value -= (switch << rice) - (1 << exp)
        length = value.bit_length()
        return "0" * (length - 1 - exp + switch) + f"{value:b}"
    tail = f"{value & ((1 << rice) - 1):0{rice}b}" if rice else ""
    return "0" * (value >> rice) + "1" + tail


def plane_bits(blocks, matrix, q: int) -> tuple[str, int]:
    trunc = lambda a, b: abs(a) // b * (1 if a >= 0 else -1)
    out, error, scale = [], 0, max(1, matrix[0] * q)
    level = before = sign = context = None
    for i, block in enumerate(blocks):
        dc = block[0] - 0x4000
        error += abs(dc) % scale
        level = trunc(dc, scale)
        if i == 0:
            delta, book, sign, context = level, FIRST_DC_BOOK, 1, 5
        else:
            raw = level - before
            delta, book = raw * sign, DC_BOOKS[context]
            sign = -1 if raw < 0 else 1
        code = -2 * delta - 1 if delta < 0 else 2 * delta
        if i:
            context = min(code, 6)
        out.append(word(book, code))
        before = level
    run, last_run, last_level = 0, 4, 2
    for k in SCAN[1:]:
        for block in blocks:
            level = abs(block[k]) // (matrix[k] * q)
            error += abs(block[k]) % (matrix[k] * q)
            if not level:
                run += 1
                continue
            out += [word(RUN_BOOKS[min(last_run, 15)], run), word(LEVEL_BOOKS[min(last_level, 9)], level - 1), "1" if block[k] < 0 else "0"]
            run, last_run, last_level = 0, run, level
    text = "".join(out)
    return text + "0" * (-len(text) % 8), error


def alpha_bits(pixels: list[int]) -> str:
    out, before, run = [], 0xFFFF, None
    for v in pixels:
        if run is not None and v == before:
            run += 1
            continue
        if run is not None:
            out.append("1" if run == 0 else f"0{run:04b}" if run < 16 else f"0{run:015b}")
        wrapped = (v - before) % 65536
        signed = wrapped - 65536 if wrapped >= 65536 - 64 else wrapped
        out.append(f"1{wrapped:016b}" if signed == 0 or abs(signed) > 64 else f"0{abs(signed) - 1:06b}{int(signed < 0)}")
        before, run = v, 0
    out.append("1" if run == 0 else f"0{run:04b}" if run < 16 else f"0{run:015b}")
    text = "".join(out)
    return text + "0" * (-len(text) % 8)


def to_bytes(text: str) -> bytes:
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def encode(rgba: bytes, c: Config) -> bytes:
    all_planes = planes(rgba, c)
    kinds = ("luma", "full", "full") if c.is_444 else ("luma", "half", "half")
    matrices = (LUMA[c.profile], CHROMA[c.profile], CHROMA[c.profile])
    slices, header = [], 64 if c.is_444 else 48
    for row in range(c.mb_height):
        line = []
        for first in range(0, c.mb_width, 8):
            mbs = min(8, c.mb_width - first)
            line.append((first, mbs, [slice_blocks(p, k, row, first, mbs) for p, k in zip(all_planes, kinds, strict=False)]))
        paths = [[(0, 0, [])] * (c.max_q - c.min_q + 2)]  # per state: score, bits, quantizers so far
        so_far = 0
        for _, mbs, blocks in line:

            def cost(q, blocks=blocks):
                got = [plane_bits(b, m, q) for b, m in zip(blocks, matrices, strict=True)]
                return sum(len(t) for t, _ in got) + header, sum(e for _, e in got)

            so_far += mbs
            states = []
            for q in range(c.min_q, c.max_q + 1):
                n, e = cost(q)
                states.append((q, n, SCORE_LIMIT if n > 520000 else e))
            budget = c.bits_per_mb * mbs
            if states[-1][1] <= budget:
                states.append((c.max_q, states[-1][1], states[-1][2] + 1))
            else:
                low, high, found = c.max_q + 1, 127, None
                while low <= high:
                    q = (low + high) // 2
                    n, e = cost(q)
                    if n <= budget:
                        found, high = (q, n, e), q - 1
                    elif q == 127:
                        found = (128, n, e)
                        break
                    else:
                        low = q + 1
                states.append(found)
            nodes = []
            for q, n, e in states:
                best = None
                for score, have, way in paths[-1]:
                    total = have + n
                    bad = total > c.bits_per_mb * so_far or e >= SCORE_LIMIT or score >= SCORE_LIMIT
                    new = SCORE_LIMIT if bad else score + e
                    if best is None or new <= best[0]:
                        best = (new, total, [*way, q])
                nodes.append(best)
            paths.append(nodes)
        end = paths[-1][0]
        for node in paths[-1][1:]:
            if node[0] <= end[0]:
                end = node
        for (first, mbs, blocks), q in zip(line, end[2], strict=True):
            parts = [to_bytes(plane_bits(b, m, q)[0]) for b, m in zip(blocks, matrices, strict=True)]
            sizes = parts[: 3 if c.is_444 else 2]
            if c.is_444:
                a = all_planes[3]
                at = [a[min(row * 16 + y, c.height - 1)][min(first * 16 + x, c.width - 1)] for y in range(16) for x in range(16 * mbs)]
                parts.append(to_bytes(alpha_bits([v << 6 | v >> 4 for v in at])))
            slices.append(bytes([header, q]) + b"".join(len(p).to_bytes(2, "big") for p in sizes) + b"".join(parts))
    body = b"".join(slices)
    picture = b"\x40" + (8 + 2 * len(slices) + len(body)).to_bytes(4, "big") + len(slices).to_bytes(2, "big") + b"\x30" + b"".join(len(s).to_bytes(2, "big") for s in slices)
    full = int(c.is_444)
    head = b"icpf" + (148).to_bytes(2, "big") + bytes([0, full]) + b"wasm" + c.width.to_bytes(2, "big") + c.height.to_bytes(2, "big") + bytes([(2 + full) << 6, 0, 1, 1, 1, 2 * full, 0, 3]) + bytes(LUMA[c.profile]) + bytes(CHROMA[c.profile])
    return (4 + len(head) + len(picture) + len(body)).to_bytes(4, "big") + head + picture + body
