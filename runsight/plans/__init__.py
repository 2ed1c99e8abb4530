"""Registered queries; importing the package registers them all."""

from runsight.plans import catalog_queries, config_queries, log_queries, mesh_queries, name_queries, run_queries, series_queries  # noqa: F401
