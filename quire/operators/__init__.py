"""Operators over flat tables of blocks, lines, units and rectangles: DataFrame in, DataFrame out."""
