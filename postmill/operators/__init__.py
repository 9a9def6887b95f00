"""Operators over mail entities: counts, comparisons, numbering, rendering."""
