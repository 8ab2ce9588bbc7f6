"""Operators for preparing training text: filters, duplicate removal, token counts and packing.

Nothing else in the library imports this subpackage.
"""
