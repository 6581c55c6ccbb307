"""The registered queries, one module per operator family."""

from importlib import import_module

FAMILIES = (
    "curation audio scans sequences joins motion captions documents vectors evaluation streams jobs"
).split()


def load():
    """Import every family once and return the registry module."""
    for family in FAMILIES:
        import_module(f"cadenza.catalog.{family}")
    return import_module("cadenza.catalog.registry")
