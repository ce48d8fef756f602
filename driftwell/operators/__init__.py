"""DataFrame operators; each takes and returns DataFrames, so batch and streams share them."""
