"""Arguments: channel names, groups of channels, and values that differ by channel."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from .errors import SignalError, inform, warn


def starts_with(prefix: str) -> Callable[[str], bool]:
    return lambda name: name.startswith(prefix)


def ends_with(suffix: str) -> Callable[[str], bool]:
    return lambda name: name.endswith(suffix)


def contains(part: str) -> Callable[[str], bool]:
    return lambda name: part in name


def matches(pattern: str) -> Callable[[str], bool]:
    return lambda name: re.search(pattern, name) is not None


def column_names(what: Any, columns: Sequence[str]) -> list[str] | None:
    """Names from a name, a Column, a selector, or a list of them; None stays None."""
    if what is None:
        return None
    if isinstance(what, str):
        return [what]
    if callable(what) and not hasattr(what, "_jc"):
        return [c for c in columns if what(c)]
    if hasattr(what, "_jc"):
        return [what._jc.toString().strip("`")]
    if isinstance(what, Mapping):
        raise SignalError("channels are grouped by 'group_channels', not by the channel argument")
    out: list[str] = []
    for x in what:
        if isinstance(x, (list, tuple)):
            raise SignalError("channels are grouped by 'group_channels', not by the channel argument")
        out += column_names(x, columns) or []
    return list(dict.fromkeys(out))


def number(name: str, value: Any, n: int | None = None, low: float = -math.inf, high: float = math.inf, inclusive: bool | tuple[bool, bool] = True, whole: bool = False, func: str | None = None) -> Any:
    """Checks a number or a sequence of ``n`` of them; None passes."""
    if value is None:
        return None
    items = list(value) if isinstance(value, (list, tuple)) else [value]
    if n is not None and len(items) != n:
        raise SignalError(f"{name!r} must have {n} element(s)", func)
    for x in items:
        if isinstance(x, bool) or not isinstance(x, (int, float)) or math.isnan(x):
            raise SignalError(f"{name!r} must be numeric", func)
        if whole and (math.isinf(x) or x != int(x)):
            raise SignalError(f"{name!r} must be a whole number", func)
        if not within(x, (low, high), inclusive):
            raise SignalError(f"{name!r} must be between {low} and {high}", func)
    return value


def within(x: float, bounds: tuple[float, float], inclusive: bool | tuple[bool, bool] = True) -> bool:
    """Whether x lies in the bounds; each side may be open."""
    left, right = inclusive if isinstance(inclusive, tuple) else (inclusive, inclusive)
    return (x >= bounds[0] if left else x > bounds[0]) and (x <= bounds[1] if right else x < bounds[1])


def width_span(width: Any, span: Any, func: str | None = None, verbose: bool = False) -> tuple[int | None, float | None]:
    """One of width (samples) and span (time) at least; width wins."""
    if width is None and span is None:
        raise SignalError("window size undefined: give 'width' or 'span'", func)
    number("width", width, 1, 1, whole=True, func=func)
    number("span", span, 1, 0, func=func)
    if width is not None and span is not None:
        inform("'width' overrides 'span'", func, verbose)
    return (int(width), None) if width is not None else (None, float(span))


def choice(name: str, value: Any, choices: Sequence[str], func: str | None = None) -> str:
    if value not in choices:
        raise SignalError(f"{name!r} must be one of {', '.join(choices)}", func)
    return value


def group_channels(channels: Sequence[str], groups: Any, func: str | None = None) -> dict[str, list[str]]:
    """Groups by name: "ensemble" is one group, "distinct" one each, else a list or mapping of lists.

    Channels left out form groups of their own; an unnamed group is called by its first member.
    """
    if isinstance(groups, str):
        choice("group_channels", groups, ("ensemble", "distinct"), func)
        groups = [list(channels)] if groups == "ensemble" else [[c] for c in channels]
    if isinstance(groups, Mapping):
        pairs = [(k, [v] if isinstance(v, str) else list(v)) for k, v in groups.items()]
    elif isinstance(groups, (list, tuple)):
        pairs = [(None, [g] if isinstance(g, str) else list(g)) for g in groups]
    else:
        raise SignalError("'group_channels' must be 'ensemble', 'distinct', or lists of channels", func)
    for i, (name, g) in enumerate(pairs):
        if not g:
            raise SignalError(f"'group_channels': empty group {name or f'position {i + 1}'}", func)
    members = [c for _, g in pairs for c in g]
    if unknown := [c for c in members if c not in channels]:
        raise SignalError(f"'group_channels': channel(s) {', '.join(unknown)} not recognised", func)
    if twice := sorted({c for c in members if members.count(c) > 1}):
        raise SignalError(f"'group_channels': channel(s) {', '.join(twice)} assigned to more than one group", func)
    pairs += [(None, [c]) for c in channels if c not in members]
    names = [k or g[0] for k, g in pairs]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise SignalError(f"'group_channels': duplicated group name(s) {', '.join(twice)}", func)
    return dict(zip(names, (g for _, g in pairs), strict=True))


def interval_channels(channels: Sequence[str], groups: Any, func: str | None = None) -> list[list[str]]:
    """Channels of each interval (or group of intervals); channels may repeat, None is all."""
    if groups is None:
        return [list(channels)]
    if isinstance(groups, str):
        groups = [groups]
    if all(isinstance(g, str) for g in groups):
        groups = [list(groups)]
    out = [[g] if isinstance(g, str) else list(g) for g in groups]
    if unknown := [c for g in out for c in g if c not in channels]:
        raise SignalError(f"'group_channels': channel(s) {', '.join(unknown)} not recognised", func)
    return out


def per_channel(
    channels: Sequence[str],
    values: Mapping[str, Any],
    defaults: Mapping[str, Any] | None = None,
    choices: Mapping[str, Sequence[str]] | None = None,
    groups: Mapping[str, Sequence[str]] | None = None,
    verbose: bool = True,
    func: str | None = None,
) -> dict[str, dict[str, Any]]:
    """Each argument's value for each channel, or for each group.

    A mapping whose keys are channels or groups gives a value for each; its key None
    stands for all others. Members of a group must agree.
    """
    defaults, choices = defaults or {}, choices or {}
    units = {k: list(v) for k, v in groups.items()} if groups is not None else {c: [c] for c in channels}
    valid = {*channels, *units}
    for name, value in values.items():
        if isinstance(value, Mapping):
            keys = [k for k in value if k is not None]
            if unknown := [k for k in keys if k not in valid]:
                warn(f"{name!r}: channel(s) {', '.join(unknown)} not recognised", func, verbose)
            if None not in value and (left := [u for u, m in units.items() if not {u, *m} & set(keys)]):
                warn(f"{name!r}: channel(s) {', '.join(left)} not specified", func, verbose)
    out: dict[str, dict[str, Any]] = {}
    for unit, members in units.items():
        row: dict[str, Any] = {}
        for name, value in values.items():
            if isinstance(value, Mapping):
                hits = [value[k] for k in dict.fromkeys([unit, *members]) if k in value]
                if any(h != hits[0] for h in hits):
                    raise SignalError(f"{name!r} has conflicting values within group {unit}", func)
                value = hits[0] if hits and hits[0] is not None else value.get(None)
            if value is None:
                value = defaults.get(name)
            if name in choices and value is not None:
                choice(name, value, choices[name], func)
            row[name] = value
        out[unit] = row
    return out


def as_list(x: Any) -> list:
    return list(x) if isinstance(x, Iterable) and not isinstance(x, (str, bytes, Mapping)) else [x]
