"""Operators of a training-data pipeline. Nothing else in the library imports this."""

from skein.functions import tokens  # noqa: F401
