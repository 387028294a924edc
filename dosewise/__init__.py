"""Longitudinal prescription-claims analytics as plain DataFrame functions."""
