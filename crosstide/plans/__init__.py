"""Named factor sets and dataset preparation."""
