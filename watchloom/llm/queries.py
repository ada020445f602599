"""The registered queries of this package and their SQL."""

from importlib import import_module

MODULES = ("quality", "lines", "simhash", "winnow", "bpe", "revisits", "quotes", "ecoc", "packing", "licenses", "preference", "audit", "pivots")


def load_all() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"watchloom.llm.{name}")
        for key, value in vars(module).items():
            if key.startswith("op") and callable(value) and "_" in key:
                queries[key] = value
                sql = getattr(module, f"{key.partition('_')[0].upper()}_SQL", None)
                if sql:
                    oracles[key] = sql
    return queries, oracles
