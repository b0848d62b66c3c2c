"""Operators for preparing training corpora: near-duplicates, secrets, quality, tokens, media, archives.

Nothing else in the library imports this subpackage.
"""
