"""Shifting channels, alone or in groups, by or to a value."""

from __future__ import annotations

from typing import Any

from .. import args as A
from ..errors import SignalError, inform
from ..frame import ROW, SERIES, SignalFrame
from ..functions import windows as W
from .replace import _with


def shift(sf: SignalFrame, channels: Any = None, time_channel: Any = None, group_channels: Any = "ensemble", to: Any = None, by: Any = None, width: Any = None, span: Any = None, position: Any = "min", verbose: bool = True) -> SignalFrame:
    """Adds ``by``, or moves each group so that its reference becomes ``to``.

    The reference is the least or greatest mean of a complete window, or the mean of
    the first samples; a group takes the least, greatest or mean of its channels'.
    """
    func = "shift"
    sf._need_columns(2, func)
    names = sf.channel_names(channels, func)
    groups = A.group_channels(names, group_channels, func)
    time = sf.time_name(time_channel, func)
    per = A.per_channel(names, {"to": to, "by": by, "width": width, "span": span, "position": position}, {"position": "min"}, {"position": ("min", "max", "first")}, groups, verbose, func)
    t = W.q(time)
    cleaned, means, refs, out = {}, {}, {}, {}
    n, asked_rate = 0, False
    first_key = next(iter(groups))
    for key, members in groups.items():
        a = per[key]
        if a["to"] is None and a["by"] is None:
            raise SignalError("shift value undefined: give 'to' or 'by'", func)
        A.number("to", a["to"], 1, func=func)
        A.number("by", a["by"], 1, func=func)
        cleaned |= {c: W.clean(c) for c in members}
        if a["to"] is None:
            out |= {c: f"{W.q(c)} + {float(a['by'])!r}D" for c in members}
            continue
        if a["by"] is not None:
            inform(f"'to' = {a['to']:g} overrides 'by'", func, verbose and key == first_key)
        w, s = A.width_span(a["width"], a["span"], func, verbose and key == first_key)
        each = []
        for c in members:
            x = W.q(c)
            if a["position"] == "first":
                early = f"{ROW} < {w}" if w is not None else f"{t} <= first({t}) OVER (PARTITION BY {SERIES} ORDER BY {ROW}) + {s!r}D"
                means[f"_m{n}"] = f"case when {early} then {x} end"
                each.append(f"avg(_m{n}) OVER {W.whole()}")
            else:
                asked_rate |= s is not None
                means[f"_m{n}"] = W.rolling_mean(x, W.over(time, w, s), W.least_samples(w, s, "_rate"), skip_null=True)
                each.append(f"{a['position']}(_m{n}) OVER {W.whole()}")
            n += 1
        refs_of = [f"_r{len(refs) + k}" for k in range(len(each))]
        refs |= dict(zip(refs_of, each, strict=True))
        if a["position"] == "first":
            group = f"({' + '.join(refs_of)}) / {len(refs_of)}"
        else:
            group = refs_of[0] if len(refs_of) == 1 else f"{'least' if a['position'] == 'min' else 'greatest'}({', '.join(refs_of)})"
        out |= {c: f"{W.q(c)} - {group} + {float(a['to'])!r}D" for c in members}
    df, columns = _with(sf.df, cleaned), sf.df.columns
    if any(per[k]["span"] is not None and per[k]["width"] is None for k in groups):
        sf.check_sorted(time, func)
    if asked_rate:
        df = _with(df, {"_step": f"{t} - lag({t}) OVER (PARTITION BY {SERIES} ORDER BY {ROW})"})
        df = _with(df, {"_rate": f"1 / percentile(_step, 0.5) OVER {W.whole()}"})
        df = _with(df, {"_rate": W.snapped_sql("_rate")})
    for step in (means, refs, out):
        if step:
            df = _with(df, step)
    return sf._new(df.select(*map(W.q, columns)), channels=names, time_channel=time)
