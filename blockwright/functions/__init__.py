"""Byte codecs as plain functions: bytes in, bytes out. ``CorruptData`` on anything that does not follow the format."""


class CorruptData(ValueError):
    """Input that does not follow its format."""
