"""Building blocks: each takes and returns DataFrames and runs no query by itself,
except where a docstring says that a summary is checkpointed."""
