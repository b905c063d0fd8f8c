"""Multi-stage plans and the query registry."""


def load_catalog() -> None:
    """Import the modules that register queries."""
    from goldsieve.plans import catalog, catalog_search  # noqa: F401
