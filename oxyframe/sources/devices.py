"""Which device wrote a file, and where its table begins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .tables import Cells


@dataclass(frozen=True)
class Device:
    """What a header row of the device's exports looks like."""

    name: str
    patterns: tuple[str, ...]
    fixed: bool
    time_channel: str | None = None


# The devices' own column headings.
DEVICES = (
    Device("Artinis", (r"^(\d+ )+(\d+|NA) ?$",), False),
    Device("Train.Red", ("Timestamp (seconds passed)", "SmO2"), True, "Timestamp (seconds passed)"),
    Device("Moxy", ("hh:mm:ss", "SmO2 Live"), True, "hh:mm:ss"),
    Device("VO2master", ("Time[s]", "SmO2[%]"), True, "Time[s]"),
    Device("PerfPro", ("Time.*SmO2",), False, "Time"),
)


def detect(rows: Cells) -> tuple[str | None, int]:
    """The device and the index of its header row; (None, 0) if none is known.

    The earliest matching row wins. A row of numbers is one device's header only if the
    program that exports it is named at or above it.
    """
    lines = [" ".join("NA" if c is None else c for c in r) for r in rows]
    numbered = [re.sub(r"( NA)+$", " NA", line) for line in lines]
    best: tuple[int, str] | None = None
    for d in DEVICES:
        for i, line in enumerate(lines if d.fixed else numbered):
            if best is not None and i >= best[0]:
                break
            if all(p in line if d.fixed else re.search(p, line) for p in d.patterns):
                best = (i, d.name)
                break
    if best is None:
        return None, 0
    if best[1] == "Artinis" and not any("oxysoft" in line.lower() for line in lines[: best[0] + 1]):
        return None, 0
    return best[1], best[0]


def default_channels(header: list[str | None], device: str | None) -> list[str]:
    """Headings that hold signals by the device's habit."""
    named = [h for h in header if h]
    hits = [h for h in named if (h.startswith("2") if device == "Artinis" else h.upper().startswith("SMO2"))]
    return [h for h in hits if not re.search("unfiltered|averaged", h, re.IGNORECASE)]


def time_of(device: str | None) -> str | None:
    return next((d.time_channel for d in DEVICES if d.name == device), None)
