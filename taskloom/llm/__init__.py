"""Training-data pipeline operators: ten corpus-scale components, one module each.

Nothing outside this subpackage imports it.  Each module states how it treats nulls,
empty and very long texts, ties, repeated rows, empty tables and extra columns.
"""
