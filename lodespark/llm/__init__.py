"""Operators on text, vectors and rankings; nothing else in the library imports this subpackage."""
