"""Errors that stop a call. Faults of single rows go to an ``error`` column."""


class StoreError(Exception):
    """Base of all. ``where`` says what it is about, such as page=3."""

    def __init__(self, message: str = "", **where):
        super().__init__(message)
        self.where = where

    def __str__(self) -> str:
        said = super().__str__()
        return f"{said} ({', '.join(f'{k}={v}' for k, v in self.where.items())})" if self.where else said


class StorageError(StoreError):
    """A state that cannot be written or read: path, change."""


class SearchError(StoreError):
    """A search that cannot be made: query."""


class InvalidQuery(SearchError):
    pass


class RecordError(StoreError):
    """A record set that is refused: source."""


class UnsupportedFormat(StoreError):
    pass


class ParseError(StoreError):
    """A file that cannot be read: at."""


class ObjectError(ParseError):
    """number, generation"""


class PageError(ParseError):
    """page"""


class StreamError(ParseError):
    """filter"""


class FontError(ParseError):
    """font"""


class OfficeError(ParseError):
    """part"""


class EncryptedDocument(ParseError):
    pass


class ProviderError(StoreError):
    pass


class EmptyInput(ProviderError):
    pass


class ContextTooLong(ProviderError):
    pass
