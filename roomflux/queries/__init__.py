"""Registered queries: the operators applied to the driver tables, each with its SQL where there is one."""

from roomflux.queries import graph, lookup, more, normalize, regions, schedule, sequence, shapes, sources, spatial

__all__ = ["graph", "lookup", "more", "normalize", "regions", "schedule", "sequence", "shapes", "sources", "spatial"]
