"""Operators for preparing language-model training data at corpus scale.

Every module holds one operator with a general interface; ``queries`` binds
them to the tables of a data folder.  Nothing outside this package imports it.
"""
