"""Readers and writers: parameter files, delimited tables, raster and tile tables, trees, catalogues of files."""
