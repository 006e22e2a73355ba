"""Fixed values of the format: they must equal the published ones for right results."""

from __future__ import annotations

from dataclasses import dataclass

# Profiles: name, four-character code, least and greatest regular quantizer, bits per macroblock by
# size tier.
PROFILES = (
    ("Proxy", "apco", 4, 8, (300, 242, 220, 194)),
    ("LT", "apcs", 1, 9, (720, 560, 490, 440)),
    ("Standard", "apcn", 1, 6, (1050, 808, 710, 632)),
    ("HQ", "apch", 1, 6, (1566, 1216, 1070, 950)),
    ("4444", "ap4h", 1, 6, (2350, 1828, 1600, 1425)),
    ("4444XQ", "ap4x", 1, 6, (3525, 2742, 2400, 2137)),
)
# A tier ends at this many macroblocks a frame.
TIER_ENDS = (1620, 2700, 6075)

# Quantization matrices, in raster order.
_PROXY = """
 4  7  9 11 13 14 15 63
 7  7 11 12 14 15 63 63
 9 11 13 14 15 63 63 63
11 11 13 14 63 63 63 63
11 13 14 63 63 63 63 63
13 14 63 63 63 63 63 63
13 63 63 63 63 63 63 63
63 63 63 63 63 63 63 63
"""
_PROXY_CHROMA = """
 4  7  9 11 13 14 63 63
 7  7 11 12 14 63 63 63
 9 11 13 14 63 63 63 63
11 11 13 14 63 63 63 63
11 13 14 63 63 63 63 63
13 14 63 63 63 63 63 63
13 63 63 63 63 63 63 63
63 63 63 63 63 63 63 63
"""
_LT = """
 4  5  6  7  9 11 13 15
 5  5  7  8 11 13 15 17
 6  7  9 11 13 15 15 17
 7  7  9 11 13 15 17 19
 7  9 11 13 14 16 19 23
 9 11 13 14 16 19 23 29
 9 11 13 15 17 21 28 35
11 13 16 17 21 28 35 41
"""
_STANDARD = """
 4  4  5  5  6  7  7  9
 4  4  5  6  7  7  9  9
 5  5  6  7  7  9  9 10
 5  5  6  7  7  9  9 10
 5  6  7  7  8  9 10 12
 6  7  7  8  9 10 12 15
 6  7  7  9 10 11 14 17
 7  7  9 10 11 14 17 21
"""
_HQ = """
 4  4  4  4  4  4  4  4
 4  4  4  4  4  4  4  4
 4  4  4  4  4  4  4  4
 4  4  4  4  4  4  4  5
 4  4  4  4  4  4  5  5
 4  4  4  4  4  5  5  6
 4  4  4  4  5  5  6  7
 4  4  4  4  5  6  7  7
"""
_numbers = lambda text: tuple(map(int, text.split()))
LUMA = tuple(map(_numbers, (_PROXY, _LT, _STANDARD, _HQ, _HQ, _HQ)))
CHROMA = tuple(map(_numbers, (_PROXY_CHROMA, _LT, _STANDARD, _HQ, _HQ, _HQ)))

# The order in which a block's coefficients are scanned.
SCAN = _numbers("""
 0  1  8  9  2  3 10 11
16 17 24 25 18 19 26 27
 4  5 12 20 13  6  7 14
21 28 29 22 15 23 30 31
32 33 40 48 41 34 35 42
49 56 57 50 43 36 37 44
51 58 59 52 45 38 39 46
53 60 61 54 47 55 62 63
""")

# Codebooks: Rice order << 5 | exponential order << 2 | (switch - 1); by the code or run or level before.
RUN_BOOKS = (0x06, 0x06, 0x05, 0x05, 0x04, 0x29, 0x29, 0x29, 0x29, 0x28, 0x28, 0x28, 0x28, 0x28, 0x28, 0x4C)
LEVEL_BOOKS = (0x04, 0x0A, 0x05, 0x06, 0x04, 0x28, 0x28, 0x28, 0x28, 0x4C)
DC_BOOKS = (0x04, 0x28, 0x28, 0x4D, 0x4D, 0x70, 0x70)
FIRST_DC_BOOK = 0xB8

# Integer cosine basis: row u is the output frequency.
BASIS = (
    (1, 1, 1, 1, 1, 1, 1, 1),
    (11363, 9633, 6437, 2260, -2260, -6437, -9633, -11363),
    (10703, 4433, -4433, -10703, -10703, -4433, 4433, 10703),
    (9633, -2259, -11362, -6436, 6436, 11362, 2259, -9633),
    (1, -1, -1, 1, 1, -1, -1, 1),
    (6437, -11362, 2261, 9633, -9633, -2261, 11362, -6437),
    (4433, -10704, 10704, -4433, -4433, 10704, -10704, 4433),
    (2260, -6436, 9633, -11363, 11363, -9633, 6436, -2260),
)

# Colour conversion in 12-bit fixed point: red, green, blue of Y, Cb, Cr; offsets; limits.
COLOR = {
    "limited": {"y": (2992, 10066, 1016, 64, 64, 940), "cb": (-1649, -5548, 7193, 512, 64, 960), "cr": (7193, -6534, -660, 512, 64, 960)},
    "full": {"y": (3493, 11751, 1186, 0, 0, 1023), "cb": (-1883, -6336, 8217, 512, 0, 1023), "cr": (8217, -7465, -754, 512, 0, 1023)},
}

# Frame rates that are meant by their usual decimal names.
RATES = ((23.976, 24000, 1001), (29.97, 30000, 1001), (59.94, 60000, 1001))

# Seconds from the start of 1904, from which movies count time, to that of 1970.
EPOCH_1904 = 2_082_844_800

SCORE_LIMIT = (2**31 - 1) // 2
SLICE_MBS = 8
DC_OFFSET = 0x4000


@dataclass(frozen=True)
class Config:
    """An encoder's configuration, checked when it is made."""

    width: int
    height: int
    profile: int = 3
    fps_num: int = 30
    fps_den: int = 1
    color_range: str = "limited"

    def __post_init__(self):
        for name in ("width", "height", "profile", "fps_num", "fps_den"):
            if isinstance(value := getattr(self, name), bool) or not isinstance(value, int):
                raise ValueError(f"{name} must be a whole number, not {value!r}")
        if not (0 < self.width < 65536 and 0 < self.height < 65536):
            raise ValueError("width and height must be from 1 to 65535")
        if not 0 <= self.profile < len(PROFILES):
            raise ValueError("profile must be from 0 to 5")
        if self.fps_num <= 0 or self.fps_den <= 0:
            raise ValueError("a frame rate must be positive")
        if self.color_range not in COLOR:
            raise ValueError("color_range is 'limited' or 'full'")

    @property
    def is_444(self) -> bool:
        return self.profile >= 4

    @property
    def fourcc(self) -> str:
        return PROFILES[self.profile][1]

    @property
    def mb_width(self) -> int:
        return -(-self.width // 16)

    @property
    def mb_height(self) -> int:
        return -(-self.height // 16)

    @property
    def slices_per_row(self) -> int:
        return -(-self.mb_width // SLICE_MBS)

    @property
    def min_q(self) -> int:
        return PROFILES[self.profile][2]

    @property
    def max_q(self) -> int:
        return PROFILES[self.profile][3]

    @property
    def bits_per_mb(self) -> int:
        """Alpha may take much: its profiles have twenty times the bits."""
        tier = sum(self.mb_width * self.mb_height > end for end in TIER_ENDS)
        return PROFILES[self.profile][4][tier] * (20 if self.is_444 else 1)

    @property
    def frame_bytes(self) -> int:
        return self.width * self.height * 4
