"""Operators over DataFrames of blocks, chunks, assets, boxes and events."""
