"""Queries over the driver's tables, each with an equivalent SQL where one exists."""


def load_all() -> None:
    """Import every query module, which registers its queries."""
    import importlib
    import pkgutil

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
