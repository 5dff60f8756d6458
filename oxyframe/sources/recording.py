"""Device export files to signal frames.

One file is parsed by one task: headers stand anywhere in a file and rows are ragged,
so a file cannot be split. Many files are read in parallel with ``read_recordings``.
"""

from __future__ import annotations

import datetime as dt
import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SignalError, inform, warn
from ..frame import ROW, SERIES, SignalFrame
from ..functions.windows import snapped
from ..meta import SignalMeta
from ..session import ship
from . import devices, timeparse
from .tables import Cells, cells

FUNC = "read_recording"
TOGETHER = 1 << 13  # rows from which parsed files are sent on
_TIME_NAME = re.compile(r"time|duration|hms|h+:m+:s+", re.IGNORECASE)


@dataclass
class Parsed:
    """Typed columns of a file, and what they are."""

    columns: dict[str, list] = field(default_factory=dict)
    channels: list[str] = field(default_factory=list)
    time: str = ""
    event: str | None = None
    device: str | None = None
    rate: float | None = None
    start: dt.datetime | None = None


def unique(names: Sequence[str | None]) -> list[str]:
    """Blank names become ``col_<n>``; repeated ones get _1, _2, ... that are not taken."""
    filled = [n if n else f"col_{i + 1}" for i, n in enumerate(names)]
    taken, seen, out = set(filled), set(), []
    for n in filled:
        new, k = n, 0
        while new in seen or (k and new in taken):
            k += 1
            new = f"{n}_{k}"
        seen.add(new)
        out.append(new)
    return out


def _pairs(what: Any) -> list[tuple[str, str]]:
    """(new name, heading) of a heading, a list of them, or a mapping from new names."""
    if what is None:
        return []
    if isinstance(what, str):
        return [(what, what)]
    if isinstance(what, Mapping):
        return [(k or v, v) for k, v in what.items()]
    return [p for x in what for p in (_pairs(x) if not isinstance(x, str) else [(x, x)])]


def _typed(values: list[str | None], whole: bool) -> list:
    """Numbers if all are, logical values if all are, else text; ``whole`` keeps whole numbers as such."""
    known = [v for v in values if v not in (None, "", "NA")]
    text = [None if v in (None, "", "NA") else v for v in values]
    if known and all(v in ("TRUE", "FALSE", "T", "F", "true", "false") for v in known):
        return [None if v is None else v[0].upper() == "T" for v in text]
    if all(timeparse.number(v) is not None or v in ("NaN", "Inf", "-Inf") for v in known):
        numbers = [timeparse.number(v) for v in values]
        if whole and known and all(n is None or n == int(n) for n in numbers) and not any("." in v for v in known):
            return [None if n is None else int(n) for n in numbers]
        return numbers
    return text


def parse(rows: Cells, channels: Any = None, time_channel: Any = None, event_channel: Any = None, sample_rate: float | None = None, add_timestamp: bool = False, zero_time: bool = False, keep_all: bool = False, verbose: bool = True, anchor: dt.date | None = None) -> Parsed:
    """The table of a file's cells.

    Channels and time are found by the device's headings if they are not given. Times
    without a date are on ``anchor``, else on the header's day, else on 1970-01-01.
    """
    device, header_row = devices.detect(rows)
    if channels is None:
        found = devices.default_channels(rows[header_row] if rows else [], device)
        if not found:
            raise SignalError("channels cannot be determined; name them", FUNC)
        channels, keep_all = found, True
        time_channel = time_channel or devices.time_of(device)
        inform(f"{device or 'unknown'} file format; channels are {', '.join(found)}", FUNC, verbose)
    asked = _pairs(channels)
    headings = [h for _, h in asked]
    plain = [h for h in headings if not any(h == f"{o}_{n}" for o in headings for n in range(1, 99))]
    order = [header_row, *range(len(rows))]
    header_row = next((i for i in order if i < len(rows) and set(plain) <= set(rows[i])), -1)
    if header_row < 0:
        raise SignalError("channel names not detected; they are case sensitive and must match exactly", FUNC)
    header, body = rows[: header_row + 1], rows[header_row + 1 :]
    names = unique(rows[header_row])
    table = {n: [r[k] for r in body] for k, n in enumerate(names)}

    times = _pairs(time_channel)
    if not times:
        if device == "Artinis":
            times = [("sample", "1")]
        else:
            hit = next((n for n in names if _TIME_NAME.search(n)), None) or next((n for n in names if re.match(r"^\d{1,2}:\d{2}(:\d{2})?", next((v for v in table[n] if v), ""))), None)
            if hit is None:
                raise SignalError("time channel not detected; name it", FUNC)
            times = [(hit, hit)]
            inform(f"time channel is {hit}", FUNC, verbose)
    events = _pairs(event_channel)

    # Repeated headings, in the order time, event, channels.
    roles = [times, events, asked]
    old = [n for role in roles for n in unique([h for _, h in role])]
    new = unique([n for role in roles for n, _ in role])
    if missing := [n for n in old if n not in table]:
        raise SignalError(f"channel names not detected: {', '.join(missing)}; they are case sensitive and must match exactly", FUNC)
    renamed = [f"{n} -> {u}" for (n, _), u in zip([p for role in roles for p in role], new, strict=True) if n != u]
    if renamed:
        warn(f"duplicate channel names: {', '.join(renamed)}", FUNC, verbose)
    rest = [n for n in names if n not in old] if keep_all else []
    final = unique([*new, *rest])
    chosen = dict(zip(final, [*old, *rest], strict=True))
    n_time, n_event = len(times), len(events)
    time, event = final[0], final[n_time] if n_event else None
    signal = final[n_time + n_event : len(old)]

    data = {n: table[o] for n, o in chosen.items()}
    some = [i for i in range(len(body)) if any(v[i] not in (None, "") for v in data.values())]
    data = {n: [v[i] for i in some] for n, v in data.items()}
    data = {n: v for n, v in data.items() if any(x not in (None, "") for x in v)}
    if time not in data:
        raise SignalError("time channel holds no values", FUNC)

    out: dict[str, list] = {}
    for n, v in data.items():
        if n == time:
            out[n] = v
            continue
        v = [None if x is None else x.replace(",", ".") for x in v]
        out[n] = [timeparse.number(x) for x in v] if n in signal else _typed(v, n == event)
    for n in signal:
        if n in out and all(x is None for x in out[n]):
            warn(f"channel {n} holds no numeric values", FUNC, verbose)

    day = anchor or dt.date(1970, 1, 1)
    start = timeparse.start_of(header, day)
    if anchor is None and start is not None:
        day = start.date()
    out[time], moments, start = timeparse.seconds(out[time], start, zero_time, day)
    if add_timestamp and moments is not None:
        out = {k: v for n, col in out.items() for k, v in ([(n, col), ("timestamp", moments)] if n == time else [(n, col)])}
    if device == "Artinis":
        where = next(((i, k) for i, r in enumerate(header) for k, c in enumerate(r) if c == "Export sample rate"), None)
        if where is not None:
            sample_rate = timeparse.number(header[where[0]][where[1] + 1])
            added = unique([*out, "time"])[-1]
            ticks = [None if x is None else x / sample_rate for x in out[time]]
            out = {k: v for n, col in out.items() for k, v in ([(n, col), (added, ticks)] if n == time else [(n, col)])}
            time = added
    known = [x for x in out[time] if x is not None]
    if sample_rate is None:
        steps = sorted(b - a for a, b in zip(known, known[1:], strict=False))
        half = len(steps) // 2
        middle = (steps[half] if len(steps) % 2 else (steps[half - 1] + steps[half]) / 2) if steps else 0
        sample_rate = snapped(1 / middle if middle else None)
        inform(f"estimated sample rate is {sample_rate:g} Hz", FUNC, verbose)
    _report_irregular(out[time], time, verbose)
    return Parsed(out, [n for n in signal if n in out], time, event if event in out else None, device, sample_rate, start)


def _report_irregular(t: list[float | None], name: str, verbose: bool) -> None:
    seen, odd, before = set(), [], None
    for x in t:
        if x is not None and (x in seen or before is not None and (x < before or x - before >= 3600)):
            odd.append(round(x, 6))
        if x is not None:
            seen.add(x)
            before = x
    odd = list(dict.fromkeys(odd))
    if odd:
        shown = ", ".join(map(str, odd)) if len(odd) <= 5 else ", ".join(map(str, odd[:3])) + f" and {len(odd) - 3} more"
        warn(f"duplicate or irregular {name} samples: {shown}; resample first", FUNC, verbose)


def _load(spark: SparkSession, path: str | Sequence[str]):
    return spark.read.format("binaryFile").load(path)


def read_recording(spark: SparkSession, path: str, channels: Any = None, time_channel: Any = None, event_channel: Any = None, sample_rate: float | None = None, add_timestamp: bool = False, zero_time: bool = False, keep_all: bool = False, verbose: bool = True, anchor: dt.date | None = None) -> SignalFrame:
    """One file as a frame. ``channels`` are headings, or a mapping from new names to them."""
    if not re.search(r"\.(csv|tsv|txt|xlsx?)$", path, re.IGNORECASE):
        raise SignalError(f"unsupported file type: {path}; .csv, .tsv, .txt and .xlsx are read", FUNC)
    try:
        found = _load(spark, path).select("path", "content").head()
    except AnalysisException:
        found = None
    if found is None:
        raise SignalError(f"file not found: {path}", FUNC)
    p = parse(cells(bytes(found.content), path), channels, time_channel, event_channel, sample_rate, add_timestamp, zero_time, keep_all, verbose, anchor)
    kinds = {int: "bigint", float: "double", bool: "boolean", dt.datetime: "timestamp"}
    types = {n: "double" if n in p.channels or n == p.time else kinds.get(next((type(x) for x in v if x is not None), str), "string") for n, v in p.columns.items()}
    if p.event and types[p.event] == "bigint":
        types[p.event] = "int"
    rows = [(*r, i) for i, r in enumerate(zip(*p.columns.values(), strict=True))]
    df = spark.createDataFrame(rows, ", ".join([*(f"`{n}` {t}" for n, t in types.items()), f"{ROW} bigint"]))
    return SignalFrame.from_df(df, p.time, p.channels, p.event, order=ROW, device=p.device, sample_rate=p.rate, start_timestamp=p.start)


def read_recordings(spark: SparkSession, path: str | Sequence[str], channels: Any = None, time_channel: Any = None, event_channel: Any = None, sample_rate: float | None = None, zero_time: bool = False, anchor: dt.date | None = None, add_timestamp: bool = False, keep_all: bool = False, describe: bool = False) -> SignalFrame:
    """Many files in parallel, a series each (named by the file); see ``parse_recordings``.

    Without ``channels`` they are those that the device of the first file has by habit.
    """
    files = _load(spark, path).select("path", "content")
    if channels is None:
        first = files.orderBy("path").head()
        if first is None:
            raise SignalError(f"no files found: {path}", FUNC)
        channels = parse(cells(bytes(first.content), first.path), None, time_channel, event_channel, sample_rate, verbose=False).channels
    return parse_recordings(files, channels, time_channel, event_channel, sample_rate, zero_time, anchor, add_timestamp, keep_all, describe)


def parse_recordings(files: DataFrame, channels: Any, time_channel: Any = None, event_channel: Any = None, sample_rate: float | None = None, zero_time: bool = False, anchor: dt.date | None = None, add_timestamp: bool = False, keep_all: bool = False, describe: bool = False) -> SignalFrame:
    """Files (path, content) as a frame, a series each; channels are named, as the schema is fixed before reading.

    Time is in ``time``, events are text. ``add_timestamp`` gives ``timestamp``,
    ``keep_all`` the other columns as text in the map ``others``, ``describe`` the
    file's ``device`` and ``rate``. Without ``sample_rate`` each series keeps its own rate.
    """
    names = unique([n for n, _ in _pairs(channels)])
    event = (_pairs(event_channel) or [(None, None)])[0][0]
    kinds: dict[str, str] = {SERIES: "string", ROW: "bigint", "time": "double", **dict.fromkeys(names, "double")}
    kinds |= ({event: "string"} if event else {}) | ({"timestamp": "timestamp"} if add_timestamp else {}) | ({"others": "map<string,string>"} if keep_all else {}) | ({"device": "string", "rate": "double"} if describe else {})
    ship(files.sparkSession)

    def table(rows: dict[str, list]) -> pd.DataFrame:
        fixed = {"double": "float64", "timestamp": "datetime64[us]"}
        return pd.DataFrame({c: pd.Series(v, dtype=fixed.get(kinds[c], "int64" if c == ROW else "object")) for c, v in rows.items()})

    def run(batches):
        # Short files go on together: a table of its own for each takes longer than parsing it.
        rows: dict[str, list] = {c: [] for c in kinds}
        for pdf in batches:
            for where, body in zip(pdf["path"], pdf["content"], strict=True):
                p = parse(cells(bytes(body), where), channels, time_channel, event_channel, sample_rate, add_timestamp, zero_time, keep_all, False, anchor)
                n = len(p.columns[p.time])
                columns: dict[str, Any] = {SERIES: [os.path.splitext(os.path.basename(where))[0]] * n, ROW: range(n), "time": p.columns[p.time]}
                columns |= {c: p.columns.get(c, [None] * n) for c in names}
                if event:
                    columns[event] = [None if x is None else str(x) for x in p.columns.get(p.event, [None] * n)] if p.event else [None] * n
                if add_timestamp:
                    columns["timestamp"] = p.columns.get("timestamp", [None] * n)
                if keep_all:
                    rest = [c for c in p.columns if c not in (*names, p.time, p.event, "timestamp")]
                    columns["others"] = [{c: str(p.columns[c][i]) for c in rest if p.columns[c][i] is not None} for i in range(n)]
                if describe:
                    columns |= {"device": [p.device] * n, "rate": [p.rate] * n}
                for c, v in columns.items():
                    rows[c] += v
                if len(rows[ROW]) >= TOGETHER:
                    yield table(rows)
                    rows = {c: [] for c in kinds}
        if rows[ROW]:
            yield table(rows)

    df = files.select("path", "content").mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in kinds.items()))
    # pandas holds missing numbers as NaN.
    df = df.select(*[F.when(F.isnan(F.col(f"`{n}`")), None).otherwise(F.col(f"`{n}`")).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in kinds.items()])
    return SignalFrame(df, SignalMeta().with_(channels=names, time_channel="time", event_channel=event, sample_rate=sample_rate))


EXAMPLES = ("ramp.csv", "intervals.csv")


def example(name: str | None = None) -> list[str] | bytes:
    """Names of the built-in example files, or the one whose name holds ``name``, made from a rule."""
    if name is None:
        return list(EXAMPLES)
    hits = [e for e in EXAMPLES if name in e]
    if len(hits) != 1:
        raise SignalError(f"{len(hits)} examples match {name!r}: {', '.join(hits)}", "example")
    lines = ["", " example recording", " ", "mm-dd,hh:mm:ss,SmO2 Live,SmO2 Averaged,THb,Lap"]
    for i in range(120):
        s = 47833 + 2 * i
        level = 70 - i % 40 if hits[0] == "ramp.csv" else (40 if i // 30 % 2 else 70) + i % 3
        lines.append(f"06-Feb,{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d},{level},{level},{12 + i % 7 / 10:.2f},{i // 30 + 1}")
    return "\n".join(lines).encode()
