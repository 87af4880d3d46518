"""Optional dependencies."""

from __future__ import annotations

import importlib
from types import ModuleType


def require(module: str, install: str | None = None) -> ModuleType:
    """The module, or ModuleNotFoundError that says what to install."""
    try:
        return importlib.import_module(module)
    except ModuleNotFoundError as e:
        raise ModuleNotFoundError(f"{module} is not installed; install {install or module} to use this") from e
