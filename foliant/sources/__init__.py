"""File formats as tables of blocks, from the bytes that Spark's own readers give."""
