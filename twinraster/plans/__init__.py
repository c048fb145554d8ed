"""Queries over the driver tables, one per operator."""
from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every query module so that it registers itself."""
    for module in iter_modules(__path__):
        if module.name.endswith("_queries"):
            import_module(f"{__name__}.{module.name}")
