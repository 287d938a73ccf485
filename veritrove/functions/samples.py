"""Whether whole numbers from a scale can have a mean and a deviation."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from fractions import Fraction
from functools import lru_cache

from veritrove.functions import vocabulary as V

#: Largest sample that is searched; beyond it the largest variance of the scale decides.
SEARCHED = 12


def _least(k: int, s: int) -> int:
    """Least sum of squares of ``k`` whole numbers with sum ``s``."""
    q, r = divmod(s, k)
    return r * (q + 1) ** 2 + (k - r) * q * q


def _most(k: int, s: int, lo: int, hi: int) -> int:
    """Largest sum of squares of ``k`` whole numbers from ``lo`` to ``hi`` with sum ``s``."""
    if hi == lo:
        return k * lo * lo
    full, rest = divmod(s - k * lo, hi - lo)
    return full * hi * hi + (k - full) * lo * lo + (((lo + rest) ** 2 - lo * lo) if full < k else 0)


@lru_cache(maxsize=200_000)
def _reached(k: int, s: int, lo: int, hi: int, a: int, b: int) -> bool:
    """Whether ``k`` whole numbers from ``lo`` to ``hi`` have the sum ``s`` and a sum of squares from ``a`` to ``b``.

    The smallest number is chosen first.  The lower it is, the larger are the least and the largest sum of squares
    that the others can bring, so its possible values are one stretch; two numbers are told by their difference.
    """
    if not k * lo <= s <= k * hi or _least(k, s) > b or _most(k, s, lo, hi) < a:
        return False
    if k == 1:
        return a <= s * s <= b
    if k == 2:
        d = math.isqrt(max(0, 2 * a - s * s - 1)) + 1 if 2 * a > s * s else 0
        d += (d - s) % 2
        return d <= min(s - 2 * lo, 2 * hi - s) and d * d <= 2 * b - s * s
    bottom, top = max(lo, s - (k - 1) * hi), s // k
    last = _last(bottom, top, lambda x: x * x + _most(k - 1, s - x, x, hi) >= a)
    first = bottom + top - _last(bottom, top, lambda y: (x := bottom + top - y) * x + _least(k - 1, s - x) <= b)
    # Taken in leaps over the whole stretch: where there are many samples, one is met soon.
    size = last - first + 1
    leap = next((x for x in range(max(1, int(size * 0.618)), size) if math.gcd(x, size) == 1), 1)
    return any(_reached(k - 1, s - x, x, hi, a - x * x, b - x * x) for x in (first + i * leap % size for i in range(size)))


def _last(low: int, high: int, holds) -> int:
    """The last of ``low`` to ``high`` for which ``holds``, which holds up to there only; one less than ``low`` if none."""
    high += 1
    while low < high:
        middle = (low + high) // 2
        if holds(middle):
            low = middle + 1
        else:
            high = middle
    return low - 1


@lru_cache(maxsize=100_000)
def possible(mean: float, sd: float, n: int, lo: int, hi: int) -> bool | None:
    """Whether ``n`` whole numbers from ``lo`` to ``hi`` can have the mean and (population) deviation, to .01.

    Up to ``SEARCHED`` numbers every sample counts, on a scale of any width; larger samples are judged by the
    largest variance that the scale allows, and a mean off the scale gives None.
    """
    if not math.isfinite(mean) or not math.isfinite(sd):
        return False
    if n > SEARCHED:
        p = (mean - lo) / (hi - lo) if hi != lo else 0.5
        return None if p < 0 or p > 1 else sd <= math.sqrt(p * (1 - p)) * abs(hi - lo) + 0.05
    if hi < lo or abs(mean * n - round(mean * n)) > 0.01:
        return False
    total, centre = round(mean * n) - lo * n, Fraction(mean) - lo
    shift = n * centre * centre - 2 * centre * total  # what turns a sum of squares into one of squared deviations

    def fits(q: int) -> bool:
        return abs(math.sqrt(max(float((q + shift) / n), 0.0)) - sd) < 0.01

    around = lambda x: math.floor(Fraction(x) ** 2 * n - shift)
    a, b = max(_least(n, total), around(max(0.0, sd - 0.01)) - 2), around(sd + 0.01) + 2
    while a <= b and not fits(a):
        a += 1
    while b >= a and not fits(b):
        b -= 1
    # A whole number and its square are both even or both odd.
    a, b = a + (a - total) % 2, b - (b - total) % 2
    return a <= b and _reached(n, total, 0, hi - lo, a, b)


_MEAN, _SD, _N, _SCALE = (re.compile(p.replace(r"\d", "[0-9]"), re.I) for p in (V.SPRITE_MEAN, V.SPRITE_SD, V.N_EFFECT, V.SPRITE_SCALE))


def _whole(text: str) -> int | None:
    """A number that a BIGINT holds."""
    return value if len(text) < 400 and (value := int(text)) < 2**63 else None


def _nearest(places: list[int], at: int) -> int:
    """Index of the place nearest to ``at``; of two the earlier one."""
    k = bisect_left(places, at)
    return k - 1 if k == len(places) or (k and at - places[k - 1] <= places[k] - at) else k


def groups(text: str | None) -> list[dict]:
    """Means with their deviation (the k-th of either), and the nearest sample size (2 to 500) and scale (else 1 to 7)."""
    if not text:
        return []
    means = [(m.start(), float(m[1])) for m in _MEAN.finditer(text)]
    deviations = [float(m[1]) for m in _SD.finditer(text)]
    sizes = [(m.start(), v) for m in _N.finditer(text) if (v := _whole(m[1])) is not None]
    if not means or not deviations or not sizes:
        return []
    scales = [(m.start(), a, b) for m in _SCALE.finditer(text) if (a := _whole(m[1])) is not None and (b := _whole(m[2])) is not None]
    size_at, scale_at = [s[0] for s in sizes], [s[0] for s in scales]
    out = []
    for (at, mean), sd in zip(means, deviations, strict=False):
        n = sizes[_nearest(size_at, at)][1]
        lo, hi = scales[_nearest(scale_at, at)][1:] if scales else (1, 7)
        if 2 <= n <= 500:
            out.append({"mean": mean, "sd": sd, "n": n, "lo": lo, "hi": hi, "ok": possible(mean, sd, n, lo, hi)})
    return out
