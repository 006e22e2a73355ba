"""DuckDB SQL for the queries, written apart from the operators: chains of common table expressions.

The transform is a join with the basis and a grouped sum here, symbols are windows over plain rows.
"""

from __future__ import annotations

from ..functions.tables import BASIS, CHROMA, COLOR, DC_BOOKS, FIRST_DC_BOOK, LEVEL_BOOKS, LUMA, RATES, RUN_BOOKS, SCAN

Q, HQ, LT = 4, 3, 1
ODD = (131, 37)
SMALL = (128, 80)
KEYS = "frame_idx, mb_row, slice, plane"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _mul(a: str, b: str) -> str:
    return f"(((({a}) & 65535) * ({b}) + ((((({a}) >> 16) * ({b})) & 65535) << 16)) & 4294967295)"


def _case(values, index: str) -> str:
    """A short table as a list lookup."""
    return f"([{', '.join(map(str, values))}])[CAST({index} AS BIGINT) + 1]"


def pixels(width: int, height: int) -> str:
    return f"""
fx AS (SELECT i AS f FROM range((SELECT count(*) FROM events) // 1000) t(i)),
n0 AS (
  SELECT f, y, x, c, (4660 + 977 * f + (3 * (y * {width} + x) + c + 1) * 1831565813) & 4294967295 AS t
  FROM fx, range({height}) a(y), range({width}) b(x), range(3) d(c)
),
n1 AS (SELECT f, y, x, c, {_mul("xor(t, t >> 15)", "t | 1")} AS t FROM n0),
n2 AS (SELECT f, y, x, c, xor((t + {_mul("xor(t, t >> 7)", "t | 61")}) & 4294967295, t) AS t FROM n1),
n3 AS (SELECT f, y, x, c, (xor(t, t >> 14) * 40) >> 32 AS k FROM n2),
px AS (
  SELECT f AS frame_idx, y, x, max(CASE WHEN c = 0 THEN (2 * x + 10 * f + k) & 255 END) AS r,
    max(CASE WHEN c = 1 THEN (3 * y + 5 * f + k) & 255 END) AS g, max(CASE WHEN c = 2 THEN (x + y + 7 * f + k) & 255 END) AS b,
    (2 * x + y) & 255 AS a FROM n3 GROUP BY f, y, x
)"""


def _component(name: str, kind: str, clamp: bool = True) -> str:
    r, g, b, offset, low, high = COLOR[kind][name]
    raw = f"(((({r}) * r + ({g}) * g + ({b}) * b + 2048) >> 12) + {offset})"
    return f"greatest({low}, least({high}, {raw}))" if clamp else raw


def samples(width: int, height: int, full: bool, kind: str = "limited", alpha: bool = False) -> str:
    one = lambda plane, value, table="px": f"SELECT frame_idx, '{plane}' AS plane, y, x, {value} AS v FROM {table}"
    if full:
        parts = [one(n, _component(n, kind)) for n in ("y", "cb", "cr")] + [one("a", "least(1023, (a * 16430 + 2048) >> 12)")] * alpha
        return pixels(width, height) + ",\nsm AS (" + " UNION ALL ".join(parts) + ")"
    pair = """
pr AS (
  SELECT p.frame_idx, p.y, p.x // 2 AS x, (p.r + coalesce(q.r, p.r)) // 2 AS r, (p.g + coalesce(q.g, p.g)) // 2 AS g, (p.b + coalesce(q.b, p.b)) // 2 AS b
  FROM px p LEFT JOIN px q ON q.frame_idx = p.frame_idx AND q.y = p.y AND q.x = p.x + 1 WHERE p.x % 2 = 0
)"""
    parts = [one("y", _component("y", kind)), one("cb", _component("cb", kind), "pr"), one("cr", _component("cr", kind), "pr")]
    return pixels(width, height) + "," + pair + ",\nsm AS (" + " UNION ALL ".join(parts) + ")"


SUMMARY = """SELECT frame_idx, plane, count(*) AS n, min(v) AS min_v, max(v) AS max_v, CAST(sum(v) AS BIGINT) AS sum_v,
  CAST(sum(v * (x + 1 + 3 * (y + 1))) AS BIGINT) AS weighted FROM {} GROUP BY frame_idx, plane"""


def padded(full: bool, alpha: bool = False, size: tuple[int, int] = ODD) -> str:
    """A grid of the padded size looks its samples up."""
    width, height = size
    w16, h16 = -(-width // 16) * 16, -(-height // 16) * 16
    half = not full
    return samples(width, height, full, alpha=alpha) + f""",
dims(plane, own, wide) AS (VALUES ('y', {width}, {w16}), ('cb', {(width + 1) // 2 if half else width}, {w16 // 2 if half else w16}),
  ('cr', {(width + 1) // 2 if half else width}, {w16 // 2 if half else w16}), ('a', {width}, {w16})),
grid AS (SELECT f AS frame_idx, plane, y, x, least(x, own - 1) AS sx, least(y, {height - 1}) AS sy FROM fx, dims, range({h16}) a(y), range({w16}) b(x) WHERE x < wide),
pd AS (SELECT grid.frame_idx, grid.plane, grid.y, grid.x, sm.v FROM grid JOIN sm ON sm.frame_idx = grid.frame_idx AND sm.plane = grid.plane AND sm.x = sx AND sm.y = sy)"""


def tiles(full: bool, alpha: bool = False, size: tuple[int, int] = ODD) -> str:
    mbs = -(-size[0] // 16)
    half = "plane <> 'y'" if not full else "false"
    return padded(full, alpha, size) + f""",
mb AS (SELECT *, CASE WHEN {half} THEN x // 8 ELSE x // 16 END AS m FROM pd WHERE plane <> 'a'),
tl AS (
  SELECT frame_idx, y // 16 AS mb_row, m // 8 AS slice, least(8, {mbs} - 8 * (m // 8)) AS slice_width, plane,
    (m % 8) * CASE WHEN {half} THEN 2 ELSE 4 END + CASE WHEN {half} THEN (y % 16) // 8 WHEN plane = 'y' THEN 2 * ((y % 16) // 8) + (x % 16) // 8
      ELSE 2 * ((x % 16) // 8) + (y % 16) // 8 END AS block_no, y % 8 AS r, x % 8 AS c, v FROM mb
)"""


_BASIS = _values((u, k, BASIS[u][k]) for u in range(8) for k in range(8))
_BLOCK = "frame_idx, mb_row, slice, slice_width, plane, block_no"
_TURNED = f"""
basis(u, k, m) AS (VALUES {_BASIS}),
p1 AS (SELECT {_BLOCK}, r, u, CAST(sum(m * v) AS BIGINT) AS s FROM tl JOIN basis ON k = c GROUP BY {_BLOCK}, r, u),
q1 AS (SELECT {_BLOCK}, r, u, CASE WHEN u % 4 = 0 THEN s * 2 ELSE (s + 2048) >> 12 END AS p FROM p1)"""
_COEFFICIENTS = f"""
p2 AS (SELECT {_BLOCK}, q1.u AS c, b.u AS w, CAST(sum(b.m * p) AS BIGINT) AS s FROM q1 JOIN basis b ON b.k = q1.r GROUP BY {_BLOCK}, q1.u, b.u),
cf AS (SELECT {_BLOCK}, 8 * w + c AS raster, CASE WHEN w % 4 = 0 THEN (s + 2) >> 2 ELSE (s + 16384) >> 15 END AS coeff FROM p2)"""
ROWS = f"{tiles(False)},{_TURNED}"
COEF = f"{ROWS},{_COEFFICIENTS}"
DC = f"""{COEF},
d0 AS (SELECT {_BLOCK}, coeff - 16384 AS dc, CASE WHEN plane = 'y' THEN {LUMA[HQ][0]} ELSE {CHROMA[HQ][0]} END * {Q} AS scale FROM cf WHERE raster = 0),
d1 AS (SELECT *, dc // scale AS level FROM d0),
d2 AS (SELECT *, level - lag(level) OVER w AS raw FROM d1 WINDOW w AS (PARTITION BY {KEYS} ORDER BY block_no)),
d3 AS (SELECT *, lag(raw) OVER w AS prior, row_number() OVER w AS n FROM d2 WINDOW w AS (PARTITION BY {KEYS} ORDER BY block_no)),
d4 AS (SELECT *, CASE WHEN n = 1 THEN level WHEN prior < 0 THEN -raw ELSE raw END AS delta FROM d3),
d5 AS (SELECT *, CASE WHEN delta < 0 THEN -2 * delta - 1 ELSE 2 * delta END AS code FROM d4),
d6 AS (SELECT *, CASE n WHEN 1 THEN {FIRST_DC_BOOK} WHEN 2 THEN {DC_BOOKS[5]} ELSE {_case(DC_BOOKS, "least(6, lag(code) OVER w)")} END AS book
  FROM d5 WINDOW w AS (PARTITION BY {KEYS} ORDER BY block_no))"""
AC = f"""{COEF},
scan AS (SELECT i, {_case(SCAN, "i")} AS raster FROM range(1, 64) t(i)),
a0 AS (
  SELECT {_BLOCK}, (i - 1) * slice_width * CASE WHEN plane = 'y' THEN 4 ELSE 2 END + block_no AS pos, raster, coeff,
    CASE WHEN plane = 'y' THEN {_case(LUMA[HQ], "raster")} ELSE {_case(CHROMA[HQ], "raster")} END * {Q} AS weight FROM cf JOIN scan USING (raster) WHERE coeff <> 0
),
a1 AS (SELECT *, abs(coeff) // weight AS level, abs(coeff) % weight AS rest FROM a0),
a2 AS (SELECT *, pos - coalesce(lag(pos) OVER w, -1) - 1 AS run FROM a1 WHERE level > 0 WINDOW w AS (PARTITION BY {KEYS} ORDER BY pos)),
a3 AS (SELECT *, least(15, coalesce(lag(run) OVER w, 4)) AS run_context, least(9, coalesce(lag(level) OVER w, 2)) AS level_context
  FROM a2 WINDOW w AS (PARTITION BY {KEYS} ORDER BY pos))"""


def _split(book: str) -> tuple[str, str, str, str]:
    switch, rice, exp = f"((({book}) & 3) + 1)", f"(({book}) >> 5)", f"((({book}) >> 2) & 7)"
    return switch, rice, exp, f"({switch} << {rice})"


def bits(book: str, value: str) -> str:
    switch, rice, exp, limit = _split(book)
    rest = f"({value} - {limit} + (1 << {exp}))"
    return f"CAST(CASE WHEN {value} >= {limit} THEN 2 * (length(bin({rest})) - 1) - {exp} + {switch} + 1 ELSE ({value} >> {rice}) + 1 + {rice} END AS BIGINT)"


def word(book: str, value: str) -> str:
    _, rice, exp, limit = _split(book)
    code = f"CASE WHEN {value} >= {limit} THEN {value} - {limit} + (1 << {exp}) ELSE (1 << {rice}) + ({value} & ((1 << {rice}) - 1)) END"
    return f"lpad(bin({code}), CAST({bits(book, value)} AS INTEGER), '0')"


_RUN, _LEVEL = _case(RUN_BOOKS, "run_context"), _case(LEVEL_BOOKS, "level_context")
_DC_COST = f"SELECT {KEYS}, CAST(sum({bits('book', 'code')}) AS BIGINT) AS dc_bits, CAST(sum(abs(dc) % scale) AS BIGINT) AS dc_error FROM d6 GROUP BY {KEYS}"
_AC_COST = f"""SELECT {KEYS}, coalesce(ac_bits, 0) AS ac_bits, ac_error FROM (SELECT {KEYS}, CAST(sum(rest) AS BIGINT) AS ac_error FROM a1 GROUP BY {KEYS})
  LEFT JOIN (SELECT {KEYS}, CAST(sum({bits("b", "run")} + {bits("l", "(level - 1)")} + 1) AS BIGINT) AS ac_bits FROM (SELECT *, {_RUN} AS b, {_LEVEL} AS l FROM a3) GROUP BY {KEYS}) USING ({KEYS})"""
_BOTH = DC + "," + AC[len(COEF) + 1 :]
_ALPHA = f"al AS (SELECT frame_idx, y // 16 AS mb_row, x // 128 AS slice, (y % 16) * 16 * least(8, {-(-ODD[0] // 16)} - 8 * (x // 128)) + x % 128 AS i, (v << 6) | (v >> 4) AS v FROM pd WHERE plane = 'a')"
_RUNS = """m AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS new FROM al WINDOW w AS (PARTITION BY frame_idx, mb_row, slice ORDER BY i)),
      o AS (SELECT *, sum(new) OVER (PARTITION BY frame_idx, mb_row, slice ORDER BY i) AS n FROM m),
      s AS (SELECT frame_idx, mb_row, slice, n, max(v) AS v, count(*) - 1 AS run FROM o GROUP BY ALL),
      d AS (SELECT *, (v - coalesce(lag(v) OVER (PARTITION BY frame_idx, mb_row, slice ORDER BY n), 65535)) & 65535 AS diff FROM s)"""
ALPHA = f"{padded(True, True)},\n{_ALPHA}"
_BOOKS = sorted({FIRST_DC_BOOK, *RUN_BOOKS, *LEVEL_BOOKS, *DC_BOOKS})
_CODES = f"WITH k(book) AS (VALUES {_values((b,) for b in _BOOKS)}), v AS (SELECT CAST(i AS BIGINT) AS value, CAST(book AS BIGINT) AS book FROM k, range(300) t(i))"
_SIZES = "WITH p AS (SELECT event_id AS frame_idx, CAST(strlen(props) AS BIGINT) AS size FROM events)"
_ENCODERS = """WITH s AS (SELECT o_orderpriority AS sequence, CASE WHEN o_custkey % 2 = 0 THEN 'native' ELSE 'other' END AS encoder,
  (['proxy', 'lt', 'hq', '4444'])[o_orderkey % 4 + 1] AS profile, count(*) AS size_bytes FROM orders GROUP BY ALL)"""


def _clamps() -> str:
    parts = [f"SELECT '{k}' AS color_range, '{n}' AS plane, {_component(n, k, False)} AS raw, {COLOR[k][n][4]} AS low, {COLOR[k][n][5]} AS high FROM px" for k in COLOR for n in ("y", "cb", "cr")]
    return f"WITH {pixels(*SMALL)}, s AS ({' UNION ALL '.join(parts)}) SELECT color_range, plane, count(*) FILTER (raw < low) AS below, count(*) FILTER (raw > high) AS above, CAST(min(greatest(low, least(high, raw))) AS BIGINT) AS min_v, CAST(max(greatest(low, least(high, raw))) AS BIGINT) AS max_v FROM s GROUP BY ALL"


def _rate() -> str:
    usual = " ".join(f"WHEN abs(fps - {v}::DOUBLE) < 0.01::DOUBLE THEN {{{i}}}" for i, (v, _, _) in enumerate(RATES))
    num, den = usual.format(*(r[1] for r in RATES)), usual.format(*(r[2] for r in RATES))
    return f"""
WITH r AS (SELECT DISTINCT round(p_partkey / 64 + 10, 3) AS fps FROM part UNION SELECT unnest([23.976, 29.97, 59.94, 24.0, 25.0, 12.5, 14.985])::DOUBLE),
t AS (SELECT fps, d, floor(fps * d + 0.5) AS n FROM r, range(1, 1002) x(d)),
b AS (SELECT fps, min_by(n, (abs(fps - n / d), d)) AS n, min_by(d, (abs(fps - n / d), d)) AS d FROM t GROUP BY fps)
SELECT fps, CAST(CASE {num} WHEN fps = floor(fps) THEN fps ELSE n END AS BIGINT) AS num, CAST(CASE {den} WHEN fps = floor(fps) THEN 1 ELSE d END AS BIGINT) AS den FROM b"""


def _tile_sums(full: bool) -> str:
    return f"WITH {tiles(full)} SELECT {KEYS}, block_no, count(*) AS n, CAST(sum(v) AS BIGINT) AS sum_v, CAST(sum(v * (8 * r + c + 1)) AS BIGINT) AS weighted FROM tl GROUP BY {KEYS}, block_no"


ORACLES = {
    "src13_fixture": f"WITH {pixels(*SMALL)} SELECT frame_idx, count(*) AS n, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in "rgba") + " FROM px GROUP BY frame_idx",
    "src7_natural_order": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS frame_idx, 'shot_' || p_partkey || '.PNG' AS name FROM part",
    "src9_first_frames": f"{_SIZES} SELECT * FROM p WHERE frame_idx < 150",
    "prj1_yuv422": f"WITH {samples(*SMALL, False)} {SUMMARY.format('sm')}",
    "prj1_yuv422_odd": f"WITH {samples(*ODD, False)} {SUMMARY.format('sm')}",
    "prj2_yuv444": f"WITH {samples(*SMALL, True)} {SUMMARY.format('sm')}",
    "prj3_yuva444": f"WITH {samples(*SMALL, True, 'full', True)} {SUMMARY.format('sm')}",
    "prj4_clamp": _clamps(),
    "prj5_pad": f"WITH {padded(False)} {SUMMARY.format('pd')}",
    "prj6_alpha16": f"WITH {ALPHA} SELECT frame_idx, mb_row, slice, count(*) AS n, CAST(sum(v) AS BIGINT) AS sum_v, CAST(sum(v * (i % 97 + 1)) AS BIGINT) AS weighted FROM al GROUP BY ALL",
    "prj7_tiles": _tile_sums(False),
    "prj7_tiles_444": _tile_sums(True),
    "prj8_quant_ac": f"WITH {AC} SELECT {KEYS}, count(*) AS n, count(*) FILTER (level > 0) AS coded, CAST(sum(level) AS BIGINT) AS sum_level, CAST(sum(rest) AS BIGINT) AS sum_rest FROM a1 GROUP BY {KEYS}",
    "prj9_quant_dc": f"WITH {DC} SELECT {KEYS}, block_no, dc, level FROM d1",
    "prj10_matrix": f"SELECT plane, raster, q, greatest(1, m * q) AS weight FROM (SELECT 'y' AS plane, i AS raster, CAST({_case(LUMA[LT], 'i')} AS BIGINT) AS m FROM range(64) t(i) UNION ALL SELECT 'cb', i, {_case(CHROMA[LT], 'i')} FROM range(64) t(i)), range(1, 10) u(q)",
    "trf1_dct_rows": f"WITH {ROWS} SELECT {KEYS}, block_no, r, " + ", ".join(f"max(CASE WHEN u = {u} THEN p END) AS p{u}" for u in range(8)) + f" FROM q1 GROUP BY {KEYS}, block_no, r",
    "trf1_dct_block": f"WITH {COEF} SELECT {KEYS}, block_no, max(CASE WHEN raster = 0 THEN coeff END) AS dc, max(CASE WHEN raster = 63 THEN coeff END) AS last, CAST(sum(coeff * (raster + 1)) AS BIGINT) AS weighted, count(*) FILTER (coeff <> 0) AS nonzero FROM cf GROUP BY {KEYS}, block_no",
    "win1_dc_delta": f"WITH {DC} SELECT {KEYS}, block_no, delta FROM d4",
    "win2_dc_codebook": f"WITH {DC} SELECT {KEYS}, block_no, code, CAST(book AS BIGINT) AS book FROM d6",
    "win3_scan_pos": f"WITH {AC} SELECT {KEYS}, count(*) AS n, max(pos) AS last_pos, CAST(sum(pos * coeff) AS BIGINT) AS weighted, CAST(sum(raster) AS BIGINT) AS sum_raster FROM a0 GROUP BY {KEYS}",
    "win4_runs": f"WITH {AC} SELECT {KEYS}, count(*) AS n, CAST(sum(run) AS BIGINT) AS sum_run, max(run) AS max_run, CAST(sum(run * level) AS BIGINT) AS weighted FROM a2 GROUP BY {KEYS}",
    "win5_ac_context": f"WITH {AC} SELECT {KEYS}, run_context, level_context, count(*) AS n FROM a3 GROUP BY ALL",
    "win6_alpha_rle": f"""WITH {ALPHA}, {_RUNS}
      SELECT frame_idx, mb_row, slice, count(*) AS islands, CAST(sum(run) AS BIGINT) AS sum_run, CAST(sum(diff) AS BIGINT) AS sum_diff,
        CAST(sum(CASE WHEN diff BETWEEN 1 AND 64 OR diff >= 65536 - 64 THEN 8 ELSE 17 END + CASE WHEN run = 0 THEN 1 WHEN run < 16 THEN 5 ELSE 16 END) AS BIGINT) AS bits FROM d GROUP BY ALL""",
    "agg1_code_bits": f"{_CODES} SELECT book, value, {bits('book', 'value')} AS bits FROM v",
    "bit2_codewords": f"{_CODES} SELECT book, value, {word('book', 'value')} AS word FROM v",
    "bit3_zigzag": "SELECT i AS value, CASE WHEN i < 0 THEN -2 * i - 1 ELSE 2 * i END AS code FROM range(-500, 500) t(i)",
    "bit4_run_level": f"SELECT i AS context, CAST({_case(RUN_BOOKS, 'i')} AS BIGINT) AS run_book, CAST({_case(LEVEL_BOOKS, 'least(i, 9)')} AS BIGINT) AS level_book FROM range(16) t(i)",
    "agg2_dc_cost": f"WITH {DC} {_DC_COST}",
    "agg3_ac_cost": f"WITH {AC} {_AC_COST}",
    "agg4_plane_cost": f"WITH {_BOTH}, x AS ({_DC_COST}), z AS ({_AC_COST}) SELECT {KEYS}, (dc_bits + coalesce(ac_bits, 0) + 7) // 8 * 8 AS bits, dc_error + coalesce(ac_error, 0) AS error FROM x LEFT JOIN z USING ({KEYS})",
    "bit1_plane_bits": f"""WITH {_BOTH}, s AS (
      SELECT {KEYS}, 0 AS kind, block_no AS place, {word("book", "code")} AS t FROM d6
      UNION ALL SELECT {KEYS}, 1, pos, {word("b", "run")} || {word("l", "(level - 1)")} || CASE WHEN coeff < 0 THEN '1' ELSE '0' END FROM (SELECT *, {_RUN} AS b, {_LEVEL} AS l FROM a3)
    ), j AS (SELECT {KEYS}, string_agg(t, '' ORDER BY kind, place) AS t FROM s GROUP BY {KEYS})
    SELECT {KEYS}, CAST((length(t) + 7) // 8 * 8 AS BIGINT) AS bits, md5(rpad(t, CAST((length(t) + 7) // 8 * 8 AS INTEGER), '0')) AS md5 FROM j""",
    "win7_offsets": f"{_SIZES} SELECT frame_idx, size, CAST(coalesce(sum(size) OVER (ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM p",
    "agg5_totals": f"{_SIZES} SELECT count(*) AS samples, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(*) * 1001 AS duration FROM p",
    "mux_file_index": f"""{_SIZES} SELECT row_number() OVER (ORDER BY frame_idx) AS sample, size,
      CAST(28 + coalesce(sum(size) OVER (ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset,
      28 + sum(size) OVER () > 4294967295 AS wide, true AS sync, CAST(1001 AS BIGINT) AS duration FROM p""",
    "win9_reorder": f"{_SIZES} SELECT * FROM p ORDER BY frame_idx",
    "win10_times": f"{_SIZES} SELECT frame_idx, size, frame_idx * 1001 AS timestamp, CAST(1001 AS BIGINT) AS duration FROM p",
    "agg6_stats": """SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) AS median, round(avg(value), 6) AS mean,
      round(coalesce(stddev_samp(value), 0), 6) AS stdev, min(value) AS least FROM events GROUP BY event_type""",
    "agg8_quality_means": "SELECT event_type, round(avg(value), 6) AS psnr_avg, round(avg(value / 100), 8) AS ssim_avg FROM events GROUP BY event_type",
    "agg7_benchmark_rows": """SELECT event_type, 150 AS frames, count(s) AS runs, round(150 / quantile_cont(s, 0.5), 2) AS fps, round(150 / min(s), 2) AS fps_best,
      round(150 / quantile_cont(s, 0.5) / 30, 2) AS realtime_x, round(quantile_cont(s, 0.5), 4) AS sec_median, round(min(s), 4) AS sec_best,
      round(coalesce(stddev_samp(s), 0), 4) AS sec_stdev, round(max(strlen(props) * 100000) / 1e6::DOUBLE, 1) AS out_mb, round(max(strlen(props) * 100000) * 8 / 1e6::DOUBLE / 5, 0) AS mbps
      FROM (SELECT *, abs(value) + 0.5::DOUBLE AS s FROM events) GROUP BY event_type""",
    "agg9_has_alpha": f"WITH {pixels(*SMALL)} SELECT frame_idx, bool_or(a < 255 AND frame_idx % 2 = 0) AS has_alpha FROM px GROUP BY frame_idx",
    "agg10_ratio": f"{_ENCODERS}, t AS (SELECT sequence, profile, max(size_bytes) FILTER (encoder = 'native') AS base, max(size_bytes) FILTER (encoder = 'other') AS other FROM s GROUP BY ALL) SELECT *, round(CASE WHEN base > 0 THEN other / base END, 9) AS ratio FROM t",
    "agg10_overview": f"{_ENCODERS} SELECT sequence, encoder, coalesce(max(size_bytes) FILTER (profile = 'hq' AND encoder <> 'other'), max(size_bytes) FILTER (profile = '4444')) AS size_bytes FROM s GROUP BY ALL",
    "agg11_pass_counts": "SELECT count(*) FILTER (value > 50) AS passed, count(*) FILTER (NOT coalesce(value > 50, false)) AS failed FROM events",
    "framerate_fraction": _rate(),
    "union_results": """SELECT o_orderstatus AS contender, count(*) AS runs, max(o_totalprice) AS fps FROM orders GROUP BY 1
      UNION ALL SELECT o_orderpriority, count(*), NULL FROM orders GROUP BY 1""",
    "join_report_order": "SELECT n_name, place, n_nationkey FROM (VALUES (CAST(4 AS BIGINT), 'NATION_4'), (1, 'NATION_12'), (3, 'ATLANTIS'), (2, 'NATION_2')) t(place, n_name) JOIN nation USING (n_name)",
    "src10_bars": "SELECT 'seq_' || p_partkey AS name, CAST(16 * p_size AS BIGINT) AS width, p_partkey % 90 AS num_frames, p_partkey % 2 AS has_alpha FROM part",
    "src11_json": f"{_ENCODERS} SELECT sequence, encoder, profile, size_bytes FROM s",
    "src12_csv": """SELECT 'a "quoted", ' || p_name AS contender, CASE WHEN p_size = 1 THEN '1 thread' ELSE p_size || ' threads' END AS threads,
      p_retailprice AS fps, p_partkey AS runs, true AS no_mbps FROM part""",
    "mux_boxes": f"""WITH n AS (SELECT count(*) // 1000 AS n FROM events), b(path, fixed, per) AS (VALUES
      ('/ftyp', 20, 0), ('/moov', 607, 12), ('/moov/mvhd', 108, 0), ('/moov/trak', 491, 12), ('/moov/trak/tkhd', 92, 0), ('/moov/trak/mdia', 391, 12),
      ('/moov/trak/mdia/mdhd', 32, 0), ('/moov/trak/mdia/hdlr', 45, 0), ('/moov/trak/mdia/minf', 306, 12), ('/moov/trak/mdia/minf/vmhd', 20, 0),
      ('/moov/trak/mdia/minf/dinf', 36, 0), ('/moov/trak/mdia/minf/dinf/dref', 28, 0), ('/moov/trak/mdia/minf/stbl', 242, 12), ('/moov/trak/mdia/minf/stbl/stsd', 130, 0),
      ('/moov/trak/mdia/minf/stbl/stts', 24, 0), ('/moov/trak/mdia/minf/stbl/stss', 16, 4), ('/moov/trak/mdia/minf/stbl/stsc', 28, 0),
      ('/moov/trak/mdia/minf/stbl/stsz', 20, 4), ('/moov/trak/mdia/minf/stbl/stco', 16, 4))
      SELECT path, CAST(fixed + per * n AS BIGINT) AS n_bytes FROM b, n WHERE n > 0""",
}
