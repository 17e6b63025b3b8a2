"""DataFrame operators of the media library: each takes and returns DataFrames."""
