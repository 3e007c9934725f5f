"""Whole plans composed of operators, and the driver queries."""
