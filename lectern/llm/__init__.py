"""Operators for large training corpora: one module per operator.

Nothing outside this subpackage imports it.  Tables in, tables out: every
operator takes and returns DataFrames and never keeps a corpus-sized value on
the driver or in one task.
"""
