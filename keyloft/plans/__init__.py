"""Query plans: pruning of parts and the registered query catalogue."""
