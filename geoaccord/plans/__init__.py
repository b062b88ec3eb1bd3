"""Analyses and registered queries."""
