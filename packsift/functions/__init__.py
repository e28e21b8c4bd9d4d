"""Pure column functions: no shuffle, no Python in the row path."""
