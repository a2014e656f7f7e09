"""Queries: operators bound to tables, each with the SQL it must agree with."""

from . import events_q, explain_q, funds_q, gates_q, panel_q, pit_q, reporting_q, reshape_q, sources_q, stats_q, streaming_q, universe_q  # noqa: F401
