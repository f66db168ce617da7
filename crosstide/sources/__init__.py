"""Readers and writers for panels, factor libraries and value stores."""
