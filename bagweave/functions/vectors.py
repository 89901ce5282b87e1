"""Scalar, vector, angle and string functions as Column expressions; all stay inside the JVM.

NaN marks an error, NULL a missing entity. Divisions are guarded, since ANSI mode raises on a zero divisor.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def nan() -> Column:
    return F.lit(NAN)


def is_nan(x: Column) -> Column:
    return F.isnan(x)


def divide(a: Column, b: Column) -> Column:
    """a / b as floating-point arithmetic has it: NaN for 0 / 0, an infinity for other x / 0."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def wrap_radians(angle: Column) -> Column:
    """An angle brought into [-pi, pi]; both ends stay as they are."""
    turn = angle % F.lit(2 * math.pi)
    return F.when(turn > math.pi, turn - 2 * math.pi).when(turn < -math.pi, turn + 2 * math.pi).otherwise(turn)


def angle_of(v: Column) -> Column:
    """Direction of a 2-D vector."""
    return F.atan2(F.get(v, F.lit(1)), F.get(v, F.lit(0)))


def copysign(size: Column, sign: Column) -> Column:
    return F.when(sign < 0, -F.abs(size)).otherwise(F.abs(size))


def reframe(origin: Column, target: Column, point: Column, dims: int = 2) -> Column:
    """point in the frame whose origin is `origin` and whose first unit vector ends at `target`.

    The offset of the target is rotated plane by plane (0, i) onto the first axis, and the point's offset with it, then
    everything is divided by the target's distance. A target at the origin gives 0/0, that is NaN.
    """
    t = [F.get(target, F.lit(i)) - F.get(origin, F.lit(i)) for i in range(dims)]
    r = [F.get(point, F.lit(i)) - F.get(origin, F.lit(i)) for i in range(dims)]
    first = t[0] if dims > 1 else F.abs(t[0])
    if dims == 1:
        r[0] = r[0] * F.when(t[0] < 0, -1.0).otherwise(1.0)
    for i in range(1, dims):
        length = F.sqrt(first * first + t[i] * t[i])
        c = F.when(length == 0, 1.0).otherwise(F.try_divide(first, length))
        s = F.when(length == 0, 0.0).otherwise(F.try_divide(t[i], length))
        r[0], r[i] = c * r[0] + s * r[i], c * r[i] - s * r[0]
        first = length
    return F.array(*(divide(x, first) for x in r))


def mahalanobis_squared(x: Column, mean: Sequence[float], precision: Sequence[Sequence[float]]) -> Column:
    """(x - mean)' precision (x - mean), with the model as literals."""
    d = [F.get(x, F.lit(i)) - float(m) for i, m in enumerate(mean)]
    terms = [d[i] * d[j] * float(precision[i][j]) for i in range(len(d)) for j in range(len(d)) if precision[i][j]]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def log_score(p: Column, positive: Column, negative: Column) -> Column:
    """positive ln p + negative ln(1 - p); a zero count adds nothing."""
    return F.when(positive > 0, positive * F.ln(F.when(p > 0, p))).otherwise(0.0) + F.when(negative > 0, negative * F.ln(F.when(p < 1, 1 - p))).otherwise(0.0)


def any_nan(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x))


def format_vector(v: Column, delimiter: str = " ") -> Column:
    """The values as text, one delimiter between them."""
    return F.array_join(F.transform(v, lambda x: x.cast("string")), delimiter)


def column_vector(v: Column) -> Column:
    """[x, y] as [[x], [y]], the shape of the JSON exports."""
    return F.transform(v, lambda x: F.array(x))


def permutations(options: int, count: int) -> Iterator[tuple[int, ...]]:
    """All ordered choices without repetition, in lexicographic order."""
    if count > options or count < 0:
        raise ValueError(f"can't take {count} of {options}")
    return itertools.permutations(range(options), count)


# strings and arrays


def cut_at(text: Column, delimiter: str, part: int) -> Column:
    """The part between delimiters, from 1."""
    return F.split_part(text, F.lit(delimiter), F.lit(part))


def tokens(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def whole_number(text: Column) -> Column:
    """The integer that a text is, or NULL."""
    return F.when(text.rlike(r"^[-+]?\d+$"), text.try_cast("bigint"))


def starts_with(text: Column, prefix: str) -> Column:
    return text.startswith(prefix)


def ends_with(text: Column, suffix: str) -> Column:
    return text.endswith(suffix)


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def file_number(name: Column) -> Column:
    """The number in a file's name."""
    return F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint")


def without_suffix(name: Column, suffix: str = ".json") -> Column:
    return F.when(name.endswith(suffix), F.substring(name, 1, F.length(name) - len(suffix))).otherwise(name)


def appended(a: Column, *values: Column) -> Column:
    return F.concat(a, F.array(*values))


def removed_at(a: Column, index: int) -> Column:
    """The array without its value at `index` (from 0)."""
    return F.concat(F.slice(a, 1, index), F.slice(a, index + 2, F.greatest(F.size(a) - index - 1, F.lit(0))))


def put_at(a: Column, index: int, value: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(i == index, value).otherwise(x))


def pinned(value: Column, *options: Column) -> Column:
    """Place of the first option list that has the value, or the number of lists."""
    out = F.lit(len(options))
    for i in reversed(range(len(options))):
        out = F.when(F.array_contains(options[i], value), i).otherwise(out)
    return out
