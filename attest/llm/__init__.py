"""Operators of a training-data pipeline: classifiers, tokens, chat, licences, duplicates, leaks and secrets."""
