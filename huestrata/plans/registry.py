"""All queries of the library proper: name -> callable(spark, sf_dir), and their SQL."""

FLAGSHIP = "ag04_weighted_quantile"
QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load_all() -> None:
    """Imports every module of queries."""
    from importlib import import_module

    for name in ("colour", "statistics", "search", "clusters", "streams", "more", "interpretation", "masks", "hierarchy", "governance", "selection", "jobs"):
        import_module(f"huestrata.plans.{name}")
