"""Whole measurements: views over tables, one field, a mosaic of fields, and their outputs."""
