"""Channel colours and plot data."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from ..errors import SignalError
from ..frame import ROW, SERIES, SignalFrame
from . import windows as W

# This library's own colours.
PALETTE = {
    "blue": "#1F77B4",
    "red": "#D6403B",
    "green": "#2E9E5B",
    "orange": "#E88A1A",
    "purple": "#7B5EA7",
    "teal": "#1B9AAA",
    "pink": "#D96BA0",
    "brown": "#8C5A3C",
    "olive": "#9A9A2F",
    "navy": "#27406F",
    "grey": "#7A7A7A",
    "black": "#222222",
}


def palette(which: int | Sequence[str] | None = None) -> list[str]:
    """All colours, the first n (interpolated above twelve), or those named."""
    colours = list(PALETTE.values())
    if which is None:
        return colours
    if isinstance(which, int):
        if which <= len(colours):
            return colours[:which]
        rgb = [tuple(int(c[i : i + 2], 16) for i in (1, 3, 5)) for c in colours]
        out = []
        for k in range(which):
            x = k * (len(rgb) - 1) / (which - 1)
            i = min(int(x), len(rgb) - 2)
            out.append("#" + "".join(f"{round(a + (b - a) * (x - i)):02X}" for a, b in zip(rgb[i], rgb[i + 1], strict=True)))
        return out
    if unknown := [n for n in which if n not in PALETTE]:
        raise SignalError(f"unknown colour(s) {', '.join(unknown)}", "palette")
    return [PALETTE[n] for n in which]


def theme(size: int = 12) -> dict[str, Any]:
    """Vega-Lite configuration of the plots: plain axes, light grid, text of one size."""
    text = {"labelFontSize": size, "titleFontSize": size, "labelColor": "#222222", "titleColor": "#222222"}
    return {"view": {"stroke": None}, "axis": {**text, "gridColor": "#E6E6E6", "domainColor": "#222222"}, "legend": text, "header": text}


def scale(names: Sequence[str], colours: int | Sequence[str] | None = None) -> dict[str, list[str]]:
    """A colour scale that maps channels, in their order, to the palette's colours or those named."""
    return {"domain": list(names), "range": palette(colours or len(names))}


def plot_data(sf: SignalFrame, channels: Any = None, drop_null: bool = False) -> DataFrame:
    """series, _i, time, channel, value: one row for each drawn point."""
    names, time = sf.channel_names(channels, "plot_data"), sf.time_name(None, "plot_data")
    pairs = ", ".join(f"'{c}', cast({W.q(c)} as double)" for c in names)
    long = sf.df.selectExpr(SERIES, ROW, f"{W.q(time)} as time", f"stack({len(names)}, {pairs}) as (channel, value)")
    return long.where("value is not null") if drop_null else long


def vega_lite(sf: SignalFrame, channels: Any = None, points: bool = False, most: int = 100_000) -> str:
    """A Vega-Lite description of the lines, a panel for each series, with every point; above ``most`` points an error asks to resample."""
    rows = plot_data(sf, channels).orderBy(SERIES, ROW).limit(most + 1).collect()
    if len(rows) > most:
        raise SignalError(f"more than {most} points to draw; resample or select series first", "vega_lite")
    names = sf.channel_names(channels, "plot")
    spec = {
        "$schema": "https://vega.github.io/schema/vega-lite/v5.json",
        "config": theme(),
        "data": {"values": [{"series": r[SERIES], "time": r["time"], "channel": r["channel"], "value": r["value"]} for r in rows]},
        "facet": {"row": {"field": "series", "type": "nominal"}},
        "spec": {
            "mark": {"type": "line", "point": points},
            "encoding": {
                "x": {"field": "time", "type": "quantitative"},
                "y": {"field": "value", "type": "quantitative"},
                "color": {"field": "channel", "type": "nominal", "scale": scale(names)},
            },
        },
    }
    return json.dumps(spec)
