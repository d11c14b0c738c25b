"""Operators of a training-data pipeline: ten methods over documents and pages.

Nothing outside this folder imports it. Every operator takes DataFrames and column
names, selects only what it needs under names of its own (columns of the caller cannot
clash), and returns real outputs; ``queries`` derives the registered results from them.
"""
