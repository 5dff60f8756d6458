"""Conditions. Each carries the user-facing function that raised it."""

from __future__ import annotations

import warnings


class SignalError(ValueError):
    """A request that cannot be carried out."""

    def __init__(self, message: str, func: str | None = None):
        self.func = func
        super().__init__(f"{func}(): {message}" if func else message)


class SignalWarning(UserWarning):
    """Something in the data or arguments that the caller should look at."""


class SignalInfo(UserWarning):
    """A choice that was made for the caller."""


def warn(message: str, func: str | None = None, verbose: bool = True) -> None:
    if verbose:
        warnings.warn(f"{func}(): {message}" if func else message, SignalWarning, stacklevel=3)


def inform(message: str, func: str | None = None, verbose: bool = True) -> None:
    if verbose:
        warnings.warn(f"{func}(): {message}" if func else message, SignalInfo, stacklevel=3)
