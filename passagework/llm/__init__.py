"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Every operator takes a DataFrame and
the names of the columns it reads, and returns exactly the columns it names:
other input columns, whatever they are called, are neither read nor returned.
"""
