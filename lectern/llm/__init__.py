"""Operators of a training-corpus pipeline; nothing else in the library imports them."""
