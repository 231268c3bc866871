"""Importing this module registers every query."""

from harborline.plans import report_queries, section_queries, series_queries, source_queries, status_queries, upkeep_queries  # noqa: F401
