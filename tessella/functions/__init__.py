"""Types, patterns and paths: the value rules of the dialect."""
