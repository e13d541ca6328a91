"""Column builders: every function returns an expression that stays inside Spark's generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_mod(key: Column, n: int | Column, salt: str | None = None) -> Column:
    """md5(str(key) + salt), read as a 128-bit number, modulo n: four 32-bit digits are folded in turn."""
    h = F.md5(F.concat(key.cast("string"), F.lit(salt or "")).cast("binary"))
    n = F.lit(n) if isinstance(n, int) else n
    digit = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")
    return reduce(lambda acc, i: ((acc * F.lit(2**32)) + digit(i)) % n, range(4), F.lit(0).cast("long")).cast("int")


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def numeric(c: Column) -> Column:
    """A number, or null for junk."""
    return F.trim(c).try_cast("double")


def standardise(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std; a constant column becomes 0."""
    return F.when(std == 0, x - mean).otherwise((x - mean) / std)


def unstandardise(z: Column, mean: Column, std: Column) -> Column:
    return z * F.when(std == 0, F.lit(1.0)).otherwise(std) + mean


def clip(x: Column, low: Column, high: Column) -> Column:
    """Winsorise; null stays null."""
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, low), high))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def row_sum(*cols: Column) -> Column:
    """Sum across columns, nulls as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])


def any_true(*cols: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cols])


def all_true(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in cols])


def recode(c: Column, mapping: dict, default=None) -> Column:
    """Values through a map; others become ``default``."""
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def bmi(kg: Column, metres: Column) -> Column:
    return kg / (metres * metres)


def chromosome(c: Column) -> Column:
    """X, Y and MT by name, others as whole numbers."""
    u = F.upper(c.cast("string"))
    return F.when(u.isin("X", "Y", "MT"), u).when(u == "M", "MT").otherwise(u.try_cast("double").cast("int").cast("string"))


def first_wanted(ids: Column, wanted: list[str], sep: str = ",") -> Column:
    """The first identifier of a separated list that is wanted."""
    return F.get(F.filter(F.transform(F.split(ids, sep), lambda x: F.trim(x)), lambda x: x.isin(*wanted)), F.lit(0))


# -- vectors -----------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def minkowski(a: Column, b: Column, p: int) -> Column:
    """Manhattan (1) or Euclidean (2) distance."""
    parts = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + (x if p == 1 else x * x))
    return total if p == 1 else F.sqrt(total)


def mirror_average(a: Column) -> Column:
    """Mean of a vector and its mirror image."""
    return F.zip_with(a, F.reverse(a), lambda x, y: (x + y) / 2)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def unpack(packed: Column, first: int | None = None) -> Column:
    """A packed cell "[1, 2]" as an array of doubles, its leftmost elements only if asked."""
    arr = F.from_json(packed, "array<double>")
    return F.slice(arr, 1, first) if first else arr


def pack(*cols: Column) -> Column:
    """Columns as one packed cell."""
    return F.to_json(F.array(*cols))


def is_packed(c: Column) -> Column:
    return c.rlike(r"^\s*\[.*\]$")


# -- colour ------------------------------------------------------------------
#: sRGB to XYZ (D65) and back, white point, and the constants of the Lab curve.
RGB_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
XYZ_RGB = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875992, 0.041556), (0.055648, -0.204043, 1.057311))
WHITE = (0.95047, 1.0, 1.08883)
LAB_EDGE, LAB_SLOPE, LAB_LIGHT = 0.008856, 7.787, 903.3
CUBE_ROOT, CUBE_ROOT_LIGHT = 0.333333, 0.3333333


def _times(matrix, *v: Column) -> tuple[Column, Column, Column]:
    return tuple(v[0] * m[0] + v[1] * m[1] + v[2] * m[2] for m in matrix)


def rgb_to_xyz(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return _times(RGB_XYZ, r, g, b)


def xyz_to_rgb(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return _times(XYZ_RGB, x, y, z)


def xyz_to_lab(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    def curve(t):
        return F.when(t > LAB_EDGE, F.pow(t, F.lit(CUBE_ROOT))).otherwise(t * LAB_SLOPE + 16.0 / 116)

    fx, fy, fz = (curve(c / w) for c, w in zip((x, y, z), WHITE, strict=True))
    light = F.when(y / WHITE[1] > LAB_EDGE, F.pow(y / WHITE[1], F.lit(CUBE_ROOT_LIGHT)) * 116 - 16).otherwise(y / WHITE[1] * LAB_LIGHT)
    return light, (fx - fy) * 500, (fy - fz) * 200


def lab_to_xyz(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Inverse by the cubic form throughout."""
    fy = (l + 16) / 116
    return tuple(F.pow(f, F.lit(3.0)) * w for f, w in zip((fy + a / 500, fy, fy - b / 200), WHITE, strict=True))


# -- sex chromosome copy numbers ----------------------------------------------
#: A copy number of X, or of Y, above these is more than none, one, two copies.
X_ONE, X_TWO = 1.05, 2.05
Y_NONE, Y_ONE = 0.05, 1.05


def sex_qc(x: Column, y: Column) -> dict[str, Column]:
    """From copy numbers of X and Y: contaminated, outlier, sex, and the deviation from the expected copies.

    Each chromosome's number falls into a band; the pair of bands is the verdict. X: up to one copy, two, more. Y: none, one, more.
    Expected are (one X, one Y) for a male and (two X, no Y) for a female; two or more X beside any Y is contaminated, and all pairs but the expected ones are outliers.
    """
    band_x = F.when(x > X_TWO, "more").when(x > X_ONE, "two").otherwise("one")
    band_y = F.when(y > Y_ONE, "more").when(y > Y_NONE, "one").otherwise("none")
    known = x.isNotNull() & y.isNotNull()
    pair = F.when(known, F.concat_ws("/", band_x, band_y))
    verdict = {"one/one": "Male", "two/none": "Female"}
    sex = F.lit("")
    for bands, name in verdict.items():
        sex = F.when(pair == bands, name).otherwise(sex)
    spread = {"Male": y - F.lit(1), "Female": (x - F.lit(2)) / F.lit(2)}
    deviation = lambda name: F.when(sex == name, spread[name]).otherwise(F.lit(0.0))
    return {
        "contaminated": pair.isin("two/one", "two/more", "more/one", "more/more"),
        "outlier": ~pair.isin(*verdict),
        "sex": sex,
        "chrX": deviation("Female"),
        "chrY": deviation("Male"),
    }


# -- select@N ------------------------------------------------------------------
def select_at_n(rank: Column, n_all: Column, n: int, replacement: bool = False) -> Column:
    """Chance that the true match is nearest among itself and n - 1 others drawn at random: no one of the rank - 1 nearer ones is drawn."""
    others, nearer = (n_all - 1).cast("double"), (rank - 1).cast("double")
    if replacement:
        return F.pow(1 - nearer / others, F.lit(float(n - 1)))
    steps = F.sequence(F.lit(0), F.lit(n - 2))
    return F.aggregate(steps, F.lit(1.0), lambda s, i: s * F.greatest(others - nearer - i, F.lit(0.0)) / (others - i))


def select_fast(rank0: Column, n_all: Column, n: int = 10) -> Column:
    """(1 - rank0 / (n_all - 1)) ** (n - 1) with 0-based ranks."""
    return F.pow(1 - rank0 / (n_all - 1), F.lit(float(n - 1)))


def select_fast_old(rank0: Column, n_all: Column, n: int = 10) -> Column:
    """The older formula, kept for comparison: (1 - (rank0 - 1) / n_all) ** (n - 1)."""
    return F.pow(1 - (rank0 - 1) / n_all, F.lit(float(n - 1)))
