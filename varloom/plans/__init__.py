"""Registered queries."""

from importlib import import_module

MODULES = ["queries_scores", "queries_intervals", "queries_labels", "queries_sequences", "queries_evaluation", "queries_variants", "queries_formats"]


def load_registry():
    """(queries, SQL) of all query modules."""
    from varloom.plans import registry

    for name in MODULES:
        import_module(f"varloom.plans.{name}")
    return registry.QUERIES, registry.oracles()
