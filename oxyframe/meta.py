"""Roles and facts that travel with a frame."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class SignalMeta:
    """Metadata of one frame; only these keys are kept."""

    device: str | None = None
    channels: tuple[str, ...] = ()
    time_channel: str | None = None
    event_channel: str | None = None
    sample_rate: float | None = None
    start_timestamp: Any = None
    interval_times: Any = None
    interval_span: Any = None

    def with_(self, **changes: Any) -> SignalMeta:
        """A copy with the given keys set; unknown keys are dropped, None leaves a key as it is."""
        known = {f.name for f in fields(self)}
        kept = {k: v for k, v in changes.items() if k in known and v is not None}
        if "channels" in kept:
            names = kept["channels"]
            kept["channels"] = tuple(dict.fromkeys([names] if isinstance(names, str) else names))
        return replace(self, **kept)

    def as_dict(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self)}
