"""Errors that callers can tell apart; each has a hint for the person who reads it."""


class EngineError(Exception):
    def __init__(self, message: str, hint: str = ""):
        super().__init__(f"{message} ({hint})" if hint else message)
        self.hint = hint


class InvalidInput(EngineError, ValueError):
    """A parameter, query or configuration value is not allowed."""


class NotFound(EngineError):
    """A path or document isn't there."""


class EmbedderUnavailable(EngineError):
    """The embedding or chat service can't be reached or fails."""


class StoreError(EngineError):
    """A stored relation can't be read or written."""
