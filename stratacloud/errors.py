"""Errors of the engine."""


class StrataError(Exception):
    """Any failure that the engine reports itself."""


class NoInputFiles(StrataError):
    """A folder holds no point files."""


class UnsupportedInput(StrataError):
    """A file that can't be read here."""


class CrsMismatch(StrataError):
    """Files in different coordinate systems."""


class FormatMismatch(StrataError):
    """Files of different point formats."""


class ExtraBytesMismatch(StrataError):
    """Files with different extra attributes."""


class GpsTimeMismatch(StrataError):
    """Files with different kinds of GPS time."""


class TemporalIndexError(StrataError):
    """A temporal index that can't be written."""
