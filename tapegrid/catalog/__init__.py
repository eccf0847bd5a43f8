"""Importing the package registers every query."""

from tapegrid.catalog import chain, features, io, labels, ladder, misc, models, scores, stream  # noqa: F401
