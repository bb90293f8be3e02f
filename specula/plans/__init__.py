"""Registered queries, a module a theme; importing any of them registers all."""

import importlib

for _module in ("colour_queries", "statistics_queries", "catalogue_queries", "signal_queries", "table_queries", "filter_queries", "stage_queries", "scene_queries", "target_queries", "metadata_queries", "name_queries", "frame_queries", "setting_queries", "measure_queries"):
    importlib.import_module(f"specula.plans.{_module}")
