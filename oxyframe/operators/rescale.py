"""Rescaling channels, alone or in groups, to a range."""

from __future__ import annotations

from typing import Any

from .. import args as A
from ..errors import SignalError
from ..frame import SignalFrame
from ..functions import windows as W
from .replace import _with


def rescale(sf: SignalFrame, channels: Any = None, group_channels: Any = "ensemble", range: Any = None, verbose: bool = True) -> SignalFrame:  # noqa: A002
    """Each group's least and greatest value (of all its channels, in each series) go to the range's ends.

    A group without spread stays as it is.
    """
    func = "rescale"
    sf._need_columns(1, func)
    if range is None:
        raise SignalError("'range' must be two numbers", func)
    names = sf.channel_names(channels, func)
    groups = A.group_channels(names, group_channels, func)
    per = A.per_channel(names, {"range": range}, groups=groups, verbose=verbose, func=func)
    columns = {}
    for key, members in groups.items():
        A.number("range", per[key]["range"], 2, func=func)
        low, high = map(float, per[key]["range"])
        ends = {}
        for f in ("min", "max"):
            each = [f"{f}({W.clean(c)}) OVER {W.whole()}" for c in members]
            ends[f] = each[0] if len(each) == 1 else f"{'least' if f == 'min' else 'greatest'}({', '.join(each)})"
        for c in members:
            x = W.clean(c)
            columns[c] = f"case when {ends['max']} - {ends['min']} = 0 then {x} else ({x} - {ends['min']}) / ({ends['max']} - {ends['min']}) * {high - low!r}D + {low!r}D end"
    return sf._new(_with(sf.df, columns), channels=names)
