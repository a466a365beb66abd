"""Registered queries: each runs library operators over the given tables and, where plain
SQL can say the same, carries that SQL for a side-by-side check."""


def load():
    import importlib

    from fleet_queries import registry
    for module in ("signals", "corpus_rows", "artifacts", "contract", "reports", "directory",
                   "changes"):
        importlib.import_module(f"fleet_queries.{module}")
    return dict(registry.QUERIES), dict(registry.ORACLE)
