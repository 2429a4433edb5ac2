"""Operators on pixels, samples, support sets and their predictions; each takes and returns DataFrames."""
