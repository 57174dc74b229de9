"""Operators for building training corpora: filtering, near-dedup, mixing, tokens, media, chat.

Nothing outside this subpackage imports it.
"""
