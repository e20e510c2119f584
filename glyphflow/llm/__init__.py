"""Operators of a training-data pipeline: tokenising, quality, de-duplication, decontamination, secrets, archives.

Nothing outside this subpackage imports it.
"""
