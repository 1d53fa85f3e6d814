"""Registered queries, grouped by family."""

from importlib import import_module
from pathlib import Path


def load():
    """Import every plan module once and return the registry."""
    for f in sorted(Path(__file__).parent.glob("*.py")):
        if f.stem not in ("__init__", "registry"):
            import_module(f"{__name__}.{f.stem}")
    return import_module(f"{__name__}.registry")
