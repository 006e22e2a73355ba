"""DuckDB SQL for coded frames and movies: the search for quantizers, slices, packets and boxes.

Written apart from the kernel: costs are grouped sums over windows, the binary search and the path
through a row's slices are unrolled into a chain of common table expressions, bytes are hex text.
"""

from __future__ import annotations

from ..functions.tables import CHROMA, DC_BOOKS, FIRST_DC_BOOK, LUMA, SCAN, SCORE_LIMIT, Config
from . import oracles
from .oracles import _ALPHA, _BLOCK, _COEFFICIENTS, _LEVEL, _RUN, _RUNS, _TURNED, KEYS, _case, bits, pixels, tiles, word

_SLICE = "frame_idx, mb_row, slice"
#: Probes that a search over 7 to 127 takes at most.
PROBES = 7


def be(value: str, size: int) -> str:
    """A number as hex digits of so many bytes."""
    return f"lpad(hex(CAST({value} AS BIGINT)), {2 * size}, '0')"


def text_hex(text: bytes) -> str:
    return "'" + text.hex() + "'"


def coefficients(c: Config) -> str:
    """dcs and acs: DC values, and nonzero AC coefficients at their places, with the matrix's entries."""
    y_blocks, blocks = 4, 4 if c.is_444 else 2
    weight = f"CASE WHEN plane = 'y' THEN {_case(LUMA[c.profile], 'raster')} ELSE {_case(CHROMA[c.profile], 'raster')} END"
    return f"""{tiles(c.is_444, c.is_444, (c.width, c.height))},{_TURNED},{_COEFFICIENTS},
scan AS (SELECT i, {_case(SCAN, "i")} AS raster FROM range(1, 64) t(i)),
dcs AS MATERIALIZED (SELECT {_BLOCK}, coeff - 16384 AS dc, {weight} AS m FROM cf WHERE raster = 0),
acs AS MATERIALIZED (SELECT {_BLOCK}, (i - 1) * slice_width * CASE WHEN plane = 'y' THEN {y_blocks} ELSE {blocks} END + block_no AS pos, coeff, {weight} AS m
  FROM cf JOIN scan USING (raster) WHERE coeff <> 0)"""


def symbols(tag: str, pairs: str) -> str:
    """{tag}_d, {tag}_a: the symbols of slices at quantizers, from a table (frame_idx, mb_row, slice, q)."""
    over = f"PARTITION BY {KEYS}, q ORDER BY"
    return f"""
{tag}_d1 AS (SELECT dcs.*, q, dc // greatest(1, m * q) AS level, abs(dc) % greatest(1, m * q) AS rest FROM dcs JOIN {pairs} USING ({_SLICE})),
{tag}_d2 AS (SELECT *, level - lag(level) OVER w AS raw, row_number() OVER w AS n FROM {tag}_d1 WINDOW w AS ({over} block_no)),
{tag}_d3 AS (SELECT *, CASE WHEN n = 1 THEN level WHEN lag(raw) OVER w < 0 THEN -raw ELSE raw END AS delta FROM {tag}_d2 WINDOW w AS ({over} block_no)),
{tag}_d4 AS (SELECT *, CASE WHEN delta < 0 THEN -2 * delta - 1 ELSE 2 * delta END AS code FROM {tag}_d3),
{tag}_d AS (SELECT *, CASE n WHEN 1 THEN {FIRST_DC_BOOK} WHEN 2 THEN {DC_BOOKS[5]} ELSE {_case(DC_BOOKS, "least(6, lag(code) OVER w)")} END AS book
  FROM {tag}_d4 WINDOW w AS ({over} block_no)),
{tag}_a1 AS (SELECT acs.*, q, abs(coeff) // (m * q) AS level, abs(coeff) % (m * q) AS rest FROM acs JOIN {pairs} USING ({_SLICE})),
{tag}_a2 AS (SELECT *, pos - coalesce(lag(pos) OVER w, -1) - 1 AS run FROM {tag}_a1 WHERE level > 0 WINDOW w AS ({over} pos)),
{tag}_a AS (SELECT *, {_RUN} AS b, {_LEVEL} AS l FROM (SELECT *, least(15, coalesce(lag(run) OVER w, 4)) AS run_context, least(9, coalesce(lag(level) OVER w, 2)) AS level_context
  FROM {tag}_a2 WINDOW w AS ({over} pos)))"""


def costs(tag: str, pairs: str, c: Config) -> str:
    """{tag}(frame_idx, mb_row, slice, q, bits, error), with the slice's header."""
    return f"""{symbols(tag, pairs)},
{tag}_x AS (SELECT {KEYS}, q, sum({bits("book", "code")}) AS n, sum(rest) AS e FROM {tag}_d GROUP BY {KEYS}, q
  UNION ALL SELECT {KEYS}, q, sum({bits("b", "run")} + {bits("l", "(level - 1)")} + 1), 0 FROM {tag}_a GROUP BY {KEYS}, q
  UNION ALL SELECT {KEYS}, q, 0, sum(rest) FROM {tag}_a1 GROUP BY {KEYS}, q),
{tag}_y AS (SELECT {KEYS}, q, CAST(sum(n) AS BIGINT) AS n, sum(e) AS e FROM {tag}_x GROUP BY {KEYS}, q),
{tag} AS MATERIALIZED (SELECT {_SLICE}, q, CAST(sum((n + 7) // 8 * 8) + {64 if c.is_444 else 48} AS BIGINT) AS bits, CAST(sum(e) AS BIGINT) AS error FROM {tag}_y GROUP BY {_SLICE}, q)"""


def search(c: Config) -> str:
    """chosen(frame_idx, mb_row, slice, q): the quantizers of the cheapest path along each row of macroblocks."""
    n, last = c.slices_per_row, c.max_q - c.min_q + 1
    out = f"""{coefficients(c)},
wide AS (SELECT DISTINCT {_SLICE}, slice_width FROM dcs),
usual AS (SELECT {_SLICE}, q FROM wide, range({c.min_q}, {c.max_q + 1}) t(q)),{costs("reg", "usual", c)},
s0 AS (SELECT {_SLICE}, slice_width * {c.bits_per_mb} AS budget, {c.max_q + 1} AS low, 127 AS high, bits > slice_width * {c.bits_per_mb} AS seek, {c.max_q} AS found, bits,
  CASE WHEN bits > 520000 THEN {SCORE_LIMIT} ELSE error END + 1 AS error FROM reg JOIN wide USING ({_SLICE}) WHERE q = {c.max_q})"""
    for k in range(1, PROBES + 1):
        hit, end = "(seek AND g.bits <= budget)", "(seek AND g.bits > budget AND g.q = 127)"
        out += f""",
try{k} AS (SELECT {_SLICE}, low + (high - low) // 2 AS q FROM s{k - 1} WHERE seek),{costs(f"g{k}", f"try{k}", c)},
r{k} AS (SELECT {", ".join(f"o.{x}" for x in _SLICE.split(", "))}, budget, seek, coalesce({hit}, false) AS hit, coalesce({end}, false) AS ended, low, high, g.q AS probe,
  CASE WHEN {hit} THEN g.q WHEN {end} THEN 128 ELSE found END AS found, CASE WHEN {hit} OR {end} THEN g.bits ELSE o.bits END AS bits,
  CASE WHEN {hit} OR {end} THEN g.error ELSE o.error END AS error FROM s{k - 1} o LEFT JOIN g{k} g USING ({_SLICE})),
s{k} AS (SELECT {_SLICE}, budget, CASE WHEN seek AND NOT hit THEN probe + 1 ELSE low END AS low, CASE WHEN hit THEN probe - 1 ELSE high END AS high,
  seek AND NOT ended AND CASE WHEN hit THEN low <= probe - 1 ELSE probe + 1 <= high END AS seek, found, bits, error FROM r{k})"""
    out += f""",
states AS MATERIALIZED (SELECT {_SLICE}, q - {c.min_q} AS state, q, bits, CASE WHEN bits > 520000 THEN {SCORE_LIMIT} ELSE error END AS error FROM reg
  UNION ALL SELECT {_SLICE}, {last}, found, bits, error FROM s{PROBES}),
t0 AS (SELECT frame_idx, mb_row, state, q, CASE WHEN bits > {c.bits_per_mb * min(8, c.mb_width)} OR error >= {SCORE_LIMIT} THEN {SCORE_LIMIT} ELSE error END AS score, bits AS total, 0 AS came FROM states WHERE slice = 0)"""
    for s in range(1, n):
        limit = c.bits_per_mb * min(8 * (s + 1), c.mb_width)
        out += f""",
u{s} AS (SELECT a.frame_idx, a.mb_row, b.state, b.q, a.state AS came, a.total + b.bits AS total,
  CASE WHEN a.total + b.bits > {limit} OR b.error >= {SCORE_LIMIT} OR a.score >= {SCORE_LIMIT} THEN {SCORE_LIMIT} ELSE a.score + b.error END AS score
  FROM t{s - 1} a JOIN states b ON b.frame_idx = a.frame_idx AND b.mb_row = a.mb_row AND b.slice = {s}),
t{s} AS (SELECT frame_idx, mb_row, state, max(q) AS q, min(score) AS score, min_by(total, (score, -came)) AS total, min_by(came, (score, -came)) AS came FROM u{s} GROUP BY frame_idx, mb_row, state)"""
    out += f""",
b{n - 1} AS (SELECT frame_idx, mb_row, min_by(state, (score, -state)) AS state FROM t{n - 1} GROUP BY frame_idx, mb_row)"""
    for s in range(n - 2, -1, -1):
        out += f""",
b{s} AS (SELECT frame_idx, mb_row, t.came AS state FROM b{s + 1} JOIN t{s + 1} t USING (frame_idx, mb_row, state))"""
    parts = " UNION ALL ".join(f"SELECT frame_idx, mb_row, CAST({s} AS BIGINT) AS slice, CAST(q AS BIGINT) AS q FROM b{s} JOIN t{s} USING (frame_idx, mb_row, state)" for s in range(n))
    return f"{out},\nchosen AS MATERIALIZED ({parts})"


def slices(c: Config) -> str:
    """coded(frame_idx, mb_row, slice, q, h): each slice's bytes as hex digits."""
    names = ("y", "cb", "cr") if c.is_444 else ("y", "cb")
    alpha = ""
    if c.is_444:
        alpha = f""",
{_ALPHA.replace(str(-(-oracles.ODD[0] // 16)) + " - 8", str(c.mb_width) + " - 8")}, {_RUNS},
e AS (SELECT *, CASE WHEN diff BETWEEN 1 AND 64 THEN '0' || lpad(bin(diff - 1), 6, '0') || '0' WHEN diff >= 65536 - 64 THEN '0' || lpad(bin(65535 - diff), 6, '0') || '1'
  ELSE '1' || lpad(bin(diff), 16, '0') END || CASE WHEN run = 0 THEN '1' WHEN run < 16 THEN '0' || lpad(bin(run), 4, '0') ELSE '0' || lpad(bin(run), 15, '0') END AS t FROM d),
am AS (SELECT {_SLICE}, string_agg(t, '' ORDER BY n) AS t FROM e GROUP BY {_SLICE})"""
    return f"""{search(c)},{symbols("fin", "chosen")},
w AS (SELECT {KEYS}, 0 AS kind, block_no AS place, {word("book", "code")} AS t FROM fin_d
  UNION ALL SELECT {KEYS}, 1, pos, {word("b", "run")} || {word("l", "(level - 1)")} || CASE WHEN coeff < 0 THEN '1' ELSE '0' END FROM fin_a){alpha},
pt AS (SELECT {KEYS}, string_agg(t, '' ORDER BY kind, place) AS t FROM w GROUP BY {KEYS}{f" UNION ALL SELECT {_SLICE}, 'a', t FROM am" if c.is_444 else ""}),
ph AS (SELECT {KEYS}, hex(CAST(CAST(rpad(t, CAST((length(t) + 7) // 8 * 8 AS INTEGER), '0') AS BIT) AS BLOB)) AS h FROM pt),
sl AS (SELECT {_SLICE}, {", ".join(f"max(h) FILTER (plane = '{n}') AS {n}" for n in ("y", "cb", "cr", "a"))} FROM ph GROUP BY {_SLICE}),
coded AS MATERIALIZED (SELECT {_SLICE}, q, '{64 if c.is_444 else 48:x}' || {be("q", 1)} || {" || ".join(be(f"length({n}) // 2", 2) for n in names)} || y || cb || cr{" || a" if c.is_444 else ""} AS h FROM sl JOIN chosen USING ({_SLICE}))"""


def frame_header(c: Config) -> bytes:
    """The fixed part of a frame's header, after its size."""
    wide = int(c.is_444)
    return b"icpf\0\x94\0" + bytes([wide]) + b"wasm" + c.width.to_bytes(2, "big") + c.height.to_bytes(2, "big") + bytes([128 + 64 * wide, 0, 1, 1, 1, 2 * wide, 0, 3, *LUMA[c.profile], *CHROMA[c.profile]])


def packets(c: Config) -> str:
    """packets(frame_idx, size, h)."""
    return f"""{slices(c)},
fr AS (SELECT frame_idx, count(*) AS n, CAST(sum(length(h) // 2) AS BIGINT) AS body, string_agg({be("length(h) // 2", 2)}, '' ORDER BY mb_row, slice) AS sizes, string_agg(h, '' ORDER BY mb_row, slice) AS h FROM coded GROUP BY frame_idx),
packets AS MATERIALIZED (SELECT frame_idx, body + 2 * n + 164 AS size,
  {be("body + 2 * n + 164", 4)} || {text_hex(frame_header(c))} || '40' || {be("body + 2 * n + 8", 4)} || {be("n", 2)} || '30' || sizes || h AS h FROM fr)"""


def _box(kind: str, *parts: str) -> str:
    body = " || ".join(parts) or "''"
    return f"({be(f'8 + length({body}) // 2', 4)} || {text_hex(kind.encode())} || {body})"


def _boxes(c: Config) -> list[tuple[str, str]]:
    """(path, SQL of the box as hex digits) of a movie's end, over tot(n, total, sizes, offsets, numbers); outer boxes last."""
    unit = "00010000" + "00000000" * 3 + "00010000" + "00000000" * 3 + "40000000"
    length, rate = be(f"n * {c.fps_den}", 4), f"'{c.fps_num:08x}'"
    name = (b"Apple ProRes 4444" if c.is_444 else b"Apple ProRes 422").ljust(31, b"\0")
    colour = _box("colr", text_hex(b"nclx" if c.color_range == "full" else b"nclc"), "'000100010001'" + (" || '80'" if c.color_range == "full" else ""))
    entry = _box(c.fourcc, f"'{'00' * 6}000100000000'", text_hex(b"appl"), f"'0000000000000200{c.width:04x}{c.height:04x}004800000048000000000000000111'", text_hex(name), "'0018ffff'", _box("fiel", "'0100'"), colour)
    at = "/moov/trak/mdia/minf/stbl/"
    leaves = [
        ("/moov/mvhd", _box("mvhd", f"'{'00' * 12}'", rate, length, f"'000100000100{'00' * 10}{unit}{'00' * 24}00000002'")),
        ("/moov/trak/tkhd", _box("tkhd", f"'00000003{'00' * 8}00000001{'00' * 4}'", length, f"'{'00' * 16}{unit}{c.width:04x}0000{c.height:04x}0000'")),
        ("/moov/trak/mdia/mdhd", _box("mdhd", f"'{'00' * 12}'", rate, length, "'55c40000'")),
        ("/moov/trak/mdia/hdlr", _box("hdlr", f"'{'00' * 8}'", text_hex(b"vide"), f"'{'00' * 12}'", text_hex(b"\x0cVideoHandler"))),
        ("/moov/trak/mdia/minf/vmhd", _box("vmhd", f"'00000001{'00' * 8}'")),
        ("/moov/trak/mdia/minf/dinf/dref", _box("dref", "'0000000000000001'", _box("url ", "'00000001'"))),
        (at + "stsd", _box("stsd", "'0000000000000001'", entry)),
        (at + "stts", _box("stts", "'0000000000000001'", be("n", 4), f"'{c.fps_den:08x}'")),
        (at + "stss", _box("stss", "'00000000'", be("n", 4), "numbers")),
        (at + "stsc", _box("stsc", "'0000000000000001000000010000000100000001'")),
        (at + "stsz", _box("stsz", "'0000000000000000'", be("n", 4), "sizes")),
        (at + "stco", _box("stco", "'00000000'", be("n", 4), "offsets")),
    ]
    return leaves


def movie(c: Config) -> str:
    """mv(place, h): the file's parts; bx(path, h): its boxes but the packets' own. Offsets are of 32 bits: fixtures are small."""
    leaves = _boxes(c)
    names = {path: "x" + path.replace("/", "_") for path, _ in leaves}
    inner = lambda kind, *parts: _box(kind, *parts)
    stbl = [names[p] for p, _ in leaves if "/stbl/" in p]
    return f"""{packets(c)},
pk AS (SELECT *, row_number() OVER w AS number, 28 + coalesce(sum(size) OVER (ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM packets WINDOW w AS (ORDER BY frame_idx)),
tot AS (SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS total, string_agg(h, '' ORDER BY frame_idx) AS h, string_agg({be("size", 4)}, '' ORDER BY frame_idx) AS sizes,
  string_agg({be("place", 4)}, '' ORDER BY frame_idx) AS offsets, string_agg({be("number", 4)}, '' ORDER BY frame_idx) AS numbers FROM pk),
m0 AS (SELECT *, {_box("ftyp", text_hex(b"qt  "), "'00000200'", text_hex(b"qt  "))} AS x_ftyp, {", ".join(f"{sql} AS {names[p]}" for p, sql in leaves)} FROM tot),
m1 AS (SELECT *, {inner("dinf", names["/moov/trak/mdia/minf/dinf/dref"])} AS x_dinf, {inner("stbl", *stbl)} AS x_stbl FROM m0),
m2 AS (SELECT *, {inner("minf", names["/moov/trak/mdia/minf/vmhd"], "x_dinf", "x_stbl")} AS x_minf FROM m1),
m3 AS (SELECT *, {inner("mdia", names["/moov/trak/mdia/mdhd"], names["/moov/trak/mdia/hdlr"], "x_minf")} AS x_mdia FROM m2),
m4 AS (SELECT *, {inner("trak", names["/moov/trak/tkhd"], "x_mdia")} AS x_trak FROM m3),
m5 AS (SELECT *, {inner("moov", names["/moov/mvhd"], "x_trak")} AS x_moov FROM m4),
mv AS (SELECT 0 AS place, x_ftyp || {be("total + 8", 4)} || {text_hex(b"mdat")} AS h FROM m5 WHERE n > 0 UNION ALL SELECT place, h FROM pk UNION ALL SELECT 28 + total, x_moov FROM m5 WHERE n > 0),
bx AS (SELECT unnest([{", ".join(f"{{'path': '{p}', 'h': {v}}}" for p, v in [("/ftyp", "x_ftyp"), ("/moov", "x_moov"), ("/moov/trak", "x_trak"), ("/moov/trak/mdia", "x_mdia"), ("/moov/trak/mdia/minf", "x_minf"), ("/moov/trak/mdia/minf/dinf", "x_dinf"), ("/moov/trak/mdia/minf/stbl", "x_stbl"), *names.items()])}], recursive := true) FROM m5 WHERE n > 0)"""


_SMALL, _ODD, _ODD_444 = Config(*oracles.SMALL), Config(*oracles.ODD, profile=3), Config(*oracles.ODD, profile=4)
_MD5 = "CAST(size AS BIGINT) AS size, md5(from_hex(h)) AS md5"
_RAW = f"""WITH {pixels(*oracles.SMALL)}, f AS (SELECT frame_idx, from_hex(string_agg({be("r", 1)} || {be("g", 1)} || {be("b", 1)} || {be("a", 1)}, '' ORDER BY y, x)) AS v FROM px GROUP BY frame_idx)
  SELECT frame_idx, CAST(octet_length(v) AS BIGINT) AS n_bytes, sha256(v) AS sha256 FROM f"""
_PACKETS = f"WITH {packets(_SMALL)} SELECT frame_idx, {_MD5} FROM packets"
_MOVIE = f"WITH {movie(_SMALL)} SELECT CAST(place AS BIGINT) AS place, CAST(length(h) // 2 AS BIGINT) AS n_bytes, md5(from_hex(h)) AS md5 FROM mv"
# The cyclic redundancy check of 32 bits, polynomial EDB88320 (a fixed value of the archive's format), one byte at a time.
_CRC_STEP = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"


def _archive() -> str:
    steps = "".join(f", c{k} AS (SELECT i, {_CRC_STEP.format(c='c')} AS c FROM c{k - 1})" for k in range(1, 9))
    return f"""WITH c0 AS (SELECT i, i AS c FROM range(256) t(i)){steps}, tb AS (SELECT list(c ORDER BY i) AS t FROM c8),
f AS (SELECT event_id AS n, printf('take_%05d.json', event_id) AS name, hex(encode(props)) AS h, CAST(octet_length(encode(props)) AS BIGINT) AS size FROM events),
b AS (SELECT n, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(size), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))) AS v FROM f),
g AS (SELECT n, xor(list_reduce(v, lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) AS crc FROM b, tb)
SELECT n, name, size, crc, CAST(coalesce(sum(30 + strlen(name) + size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM f JOIN g USING (n)"""


ORACLES = {
    "src1_frames": _RAW,
    "src6_png_sequence": _RAW,
    "src2_dimensions": """SELECT CAST(i AS BIGINT) AS frame_idx, ([NULL, 'a frame is 128 x 80, not 129 x 80', 'a frame of 128 x 80 has 40960 bytes, not 100', 'a frame of 128 x 80 has 40960 bytes, not none'])[i % 4 + 1] AS fault
      FROM range((SELECT count(*) FROM events) // 1000) t(i)""",
    "src13_gradient": """WITH g AS (SELECT f.i AS frame_idx, y, CAST(CAST(x AS DOUBLE) / 320 AS FLOAT) AS fx, CAST(CAST(y AS DOUBLE) / 240 AS FLOAT) AS fy
        FROM range((SELECT count(*) FROM events) // 1000) f(i), range(240) a(y), range(320) b(x))
      SELECT frame_idx, y, count(*) AS n, CAST(sum(floor(fx * 255::FLOAT)) AS BIGINT) AS sum_r, CAST(sum(floor(fy * 255::FLOAT)) AS BIGINT) AS sum_g,
        CAST(sum(floor((1::FLOAT - fx) * 255::FLOAT)) AS BIGINT) AS sum_b, CAST(255 * count(*) AS BIGINT) AS sum_a FROM g GROUP BY frame_idx, y""",
    "src13_alpha_pattern": f"""WITH g AS (SELECT f.i AS frame_idx, x, y * {oracles.SMALL[0]} + x AS i FROM range((SELECT count(*) FROM events) // 1000) f(i), range({oracles.SMALL[1]}) a(y), range({oracles.SMALL[0]}) b(x))
      SELECT frame_idx, CAST(200 AS BIGINT) AS r, CAST(100 AS BIGINT) AS g, CAST(50 AS BIGINT) AS b, CAST(CASE WHEN i % 4 = 0 THEN 8 WHEN i % 3 = 0 THEN 128 ELSE 255 END AS BIGINT) AS a,
        count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x FROM g GROUP BY ALL""",
    "framerate_precedence": """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN p_partkey ELSE (CAST([24000, 25, 60000, 30, 30] AS BIGINT[]))[p_partkey % 5 + 1] END AS num,
      CAST(CASE WHEN p_partkey % 6 = 0 THEN 7 ELSE ([1001, 1, 1001, 1, 1])[p_partkey % 5 + 1] END AS BIGINT) AS den FROM part""",
    "scalar_text": """WITH k AS (SELECT *, (['apco', 'apcs', 'apcn', 'apch', 'ap4h', 'ap4x', NULL])[o_orderkey % 7 + 1] AS code, o_orderkey * o_orderkey AS n FROM orders)
      SELECT o_orderkey, printf('%04X', o_orderkey % 65536) AS be16, printf('%08X', o_orderkey) AS be32, printf('%016X', o_orderkey * 1000000007) AS be64,
        CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n * 10 / 1024 + 0.5::DOUBLE) / 10) ELSE printf('%.2f MB', floor(n * 100 / 1048576 + 0.5::DOUBLE) / 100) END AS words, code AS fourcc,
        CASE WHEN code IS NOT NULL THEN o_orderkey % 7 END AS profile, printf('frame_%04d.png', o_orderkey + 1) AS name,
        CAST(epoch(o_orderdate) AS BIGINT) + 2082844800 AS seconds FROM k""",
    "src8_raw_file": _RAW,
    "src14_matte": f"""WITH {pixels(*oracles.SMALL)}, m AS (SELECT frame_idx, CAST(floor(128 + 127 * sin(2 * pi() * (x / {oracles.SMALL[0]} + y / {oracles.SMALL[1]} + frame_idx / 30.0::DOUBLE * 0.5::DOUBLE))) AS BIGINT) & 255 AS a FROM px)
      SELECT frame_idx, count(*) AS n, min(a) AS least, max(a) AS most, CAST(sum(a) AS BIGINT) AS sum_a FROM m GROUP BY frame_idx""",
    "src4_converted": _PACKETS,
    "win8_trellis": f"WITH {search(_ODD)},{costs('fin', 'chosen', _ODD)} SELECT {_SLICE}, q, bits, error FROM fin",
    "bit5_slices": f"WITH {slices(_ODD)} SELECT {_SLICE}, q, CAST(length(h) // 2 AS BIGINT) AS size, md5(from_hex(h)) AS md5 FROM coded",
    "bit6_assembled": f"WITH {packets(_ODD)} SELECT frame_idx, {_MD5} FROM packets",
    "bit7_frame_header": f"SELECT CAST(i AS BIGINT) AS frame_idx, {text_hex(frame_header(_ODD))} AS header FROM range((SELECT count(*) FROM events) // 1000) t(i)",
    "bit8_frame_md5": _PACKETS,
    "bit8_frame_4444_md5": f"WITH {packets(_ODD_444)} SELECT frame_idx, {_MD5} FROM packets",
    "stream_packets": _PACKETS,
    "mux_movie": _MOVIE,
    "stream_movie": _MOVIE,
    "mux_boxes": f"WITH {movie(_SMALL)} SELECT path, CAST(length(h) // 2 AS BIGINT) AS n_bytes, md5(from_hex(h)) AS md5 FROM bx",
    "agg12_archive": _archive(),
}
