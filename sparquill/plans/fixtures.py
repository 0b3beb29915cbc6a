"""Literal inputs of the registered queries: a query and a thesaurus."""

QUERY = ("with", "this", "thor")
THESAURUS = ("with", "thing", "this")
#: Terms in so many documents or more are what the thesaurus of the batch query knows.
KNOWN_DF = 3
