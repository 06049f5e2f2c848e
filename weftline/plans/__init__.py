"""Query analysis and whole searches."""
