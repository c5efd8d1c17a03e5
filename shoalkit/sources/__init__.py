"""Readers and writers of the landed tables, the polygon layer and the result bundle."""
