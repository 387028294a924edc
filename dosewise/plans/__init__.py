"""Compositions of operators into whole analyses."""
