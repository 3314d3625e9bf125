"""Operators composed into the reports."""
