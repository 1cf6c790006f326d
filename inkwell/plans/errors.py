"""Errors with the code that a client gets."""

from __future__ import annotations

import errno


class EngineError(Exception):
    """An error with a message and a code (a negative errno, or 400 for bad requests)."""

    def __init__(self, message: str, code: int = 400):
        super().__init__(message)
        self.message, self.code = message, code

    def to_json(self) -> dict:
        return {"error": {"message": self.message, "code": self.code}}


class BadRequest(EngineError):
    """A request that can't be read."""


class NotFound(EngineError):
    def __init__(self, message: str, code: int = -errno.ENOENT):
        super().__init__(message, code)


class ReadOnly(EngineError):
    def __init__(self, message: str = "the store is open read-only", code: int = -errno.EROFS):
        super().__init__(message, code)


class Conflict(EngineError):
    """Another writer changed what this one builds on."""

    def __init__(self, message: str, code: int = -errno.EAGAIN):
        super().__init__(message, code)


class BadStore(EngineError):
    """Stored data of another version."""

    def __init__(self, message: str, code: int = -errno.EINVAL):
        super().__init__(message, code)
