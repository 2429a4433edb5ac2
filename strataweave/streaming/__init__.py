"""Tiles as a file stream: a checkpoint remembers the finished ones, so a restarted job goes on with the rest."""
