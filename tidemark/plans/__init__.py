"""Named plans: the feature registry and the query catalogue."""
