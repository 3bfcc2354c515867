"""Operators for large-scale training-data work, each with its registered query.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when the
package is there.
"""
