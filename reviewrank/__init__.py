"""Session-event analytics on Spark: validation, grids, features, flags, risk ranking, metrics, drift."""
