"""Operators for preparing training text; nothing else in the library imports them.

Shared rules, unless an operator says otherwise: a null text is an empty text; a null id is
an id like any other and sorts last; repeated rows are separate documents with equal results;
columns other than the named ones are ignored, so their names cannot clash; an empty table
gives an empty result.
"""
