"""Operators for training-data corpora: near-duplicate joins, classifiers, tokenisation, decontamination.

Each module holds one operator with its own general interface. ``queries`` maps the
registered query names to thin wrappers that apply an operator to a whole table.
"""
