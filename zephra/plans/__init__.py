"""Query plans: roles of the given tables, and the catalog of registered queries."""


def load_catalog():
    """Queries and their oracle SQL, by name."""
    import importlib
    import pkgutil

    from zephra.plans import catalog

    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.endswith("_queries")):
        importlib.import_module(f"zephra.plans.{mod}")
    return dict(catalog.QUERIES), dict(catalog.ORACLES)
