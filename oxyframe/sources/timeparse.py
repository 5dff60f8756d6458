"""Time columns as seconds."""

from __future__ import annotations

import datetime as dt
import re

# The accepted ways to write a moment; the first has no date.
FORMATS = ("%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%d %H:%M:%S.%f", "%Y/%m/%d %H:%M:%S.%f", "%d-%m-%Y %H:%M:%S.%f", "%d/%m/%Y %H:%M:%S.%f")
# What strptime takes for each part. It keeps five compiled formats, so that seven in turn are compiled anew for each text.
_PARTS = {"Y": r"\d{4}", "m": r"1[0-2]|0[1-9]|[1-9]", "d": r"3[01]|[12]\d|0[1-9]|[1-9]| [1-9]", "H": r"2[0-3]|[01]\d|\d", "M": r"[0-5]\d|\d", "S": r"6[01]|[0-5]\d|\d", "f": r"[0-9]{1,6}", "z": r".+"}
_SHAPES = {f: re.compile(re.sub("%([a-zA-Z])", lambda m: f"(?P<{m[1]}>{_PARTS[m[1]]})", f.replace(".", r"\.").replace(" ", r"\s+")), re.IGNORECASE | re.DOTALL) for f in FORMATS}
_NO_FRACTION = re.compile(r":\d{2}$|:\d{2}(?=[+-]\d{2}:?\d{2}$|Z$)")
_LAST = re.compile(r"(:\d{2})((?:[+-]\d{2}:?\d{2}|Z)?)$")
_LONG_FRACTION = re.compile(r"(\.\d{6})\d+")


def number(x: str | None) -> float | None:
    if x is None:
        return None
    try:
        v = float(x.strip())
    except ValueError:
        return None
    return v if v == v and abs(v) != float("inf") else None


def moment(text: str | None, formats: tuple[str, ...], day: dt.date) -> dt.datetime | None:
    """A moment without time zone; one without a date is on ``day``."""
    if text is None:
        return None
    text = text.strip()
    if _NO_FRACTION.search(text):
        text = _LAST.sub(r"\1.0\2", text)
    text = _LONG_FRACTION.sub(r"\1", text)
    for f in formats:
        hit = _SHAPES[f].fullmatch(text)
        if hit is None:
            continue
        try:
            if "%z" in f:
                v = dt.datetime.strptime(text, f)
            else:
                of = hit.groupdict("1")
                v = dt.datetime(int(of.get("Y", 1900)), int(of.get("m", 1)), int(of.get("d", 1)), int(of["H"]), int(of["M"]), int(of["S"]), int(of["f"].ljust(6, "0")))
        except ValueError:
            continue
        if f == FORMATS[0]:
            v = dt.datetime.combine(day, v.time())
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v
    return None


def start_of(header: list[list[str | None]], day: dt.date) -> dt.datetime | None:
    """The earliest moment among the header's cells."""
    found = [m for r in header for c in r if c and ":" in c and (m := moment(c, FORMATS, day))]
    return min(found, default=None)


def seconds(values: list[str | None], start: dt.datetime | None, zero_time: bool, day: dt.date) -> tuple[list[float | None], list[dt.datetime | None] | None, dt.datetime | None]:
    """Seconds, moments (None if the series has none) and the first moment.

    Numbers are seconds, unless all lie in 0..1: those are shares of a day. Moments
    count from the first sample. A start from the header dates a series without dates.
    """
    numbers = [number(v) for v in values]
    dated, moments = False, None
    if any(n is not None for n in numbers):
        if all(0 <= n <= 1 for n in numbers if n is not None):
            midnight = dt.datetime.combine(day, dt.time())
            moments = [None if n is None else midnight + dt.timedelta(seconds=n * 86400) for n in numbers]
    else:
        moments = [moment(v, FORMATS[1:], day) for v in values]
        dated = any(moments)
        if not dated:
            moments = [moment(v, FORMATS[:1], day) for v in values]
    if moments is None:
        first = numbers[0] if numbers else None
        out = [None if n is None else n - first if zero_time and first is not None else n for n in numbers]
    else:
        first_moment = moments[0] if moments else None
        out = [None if m is None or first_moment is None else (m - first_moment).total_seconds() for m in moments]
    if not dated and start is not None:
        return out, [None if s is None else start + dt.timedelta(seconds=s) for s in out], start
    return out, moments, moments[0] if moments else None
