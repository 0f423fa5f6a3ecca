"""Named queries (:mod:`catalog`) and their DuckDB oracle SQL (:mod:`oracle`)."""
