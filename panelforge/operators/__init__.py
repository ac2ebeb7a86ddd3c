"""Operators on panels, matrix series and scalar series."""
