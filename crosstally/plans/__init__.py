"""Registered queries by family."""

from importlib import import_module

FAMILIES = ("reconciliation", "register", "evaluation", "charts", "documents", "catalogue", "streams")


def load_all() -> None:
    for name in FAMILIES:
        import_module(f"{__name__}.{name}")
