"""Role views over the shared tables and the registered queries built on them."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of the package so that its queries register."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
