"""Named queries over the project's tables, each with its DuckDB oracle where SQL can say it."""
