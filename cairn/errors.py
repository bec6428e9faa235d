"""Errors with a kind, and the tables that map a service's answers to kinds."""

from __future__ import annotations

import errno
from enum import Enum


class Kind(Enum):
    UNKNOWN = "unknown"
    NOT_FOUND = "not found"
    ALREADY_EXISTS = "already exists"
    CORRUPT = "corrupt"
    THROTTLED = "throttled"
    TRANSIENT = "transient"
    EXPIRED = "expired"
    INVALID = "invalid"
    PERMISSION = "permission denied"
    UNSUPPORTED = "unsupported"
    CANCELED = "canceled"


class CairnError(Exception):
    """An operation that failed, and what kind of failure it is."""

    def __init__(self, kind: Kind, op: str, cause: object):
        super().__init__(f"{op}: {cause} ({kind.value})")
        self.kind, self.op, self.cause = kind, op, cause


def kind_of(error: BaseException | None) -> Kind:
    """The kind of an error or of what it was raised from; interrupts are always canceled."""
    while error is not None:
        if isinstance(error, KeyboardInterrupt):
            return Kind.CANCELED
        if isinstance(error, CairnError):
            inner = error.cause if isinstance(error.cause, BaseException) else None
            return Kind.CANCELED if isinstance(inner, KeyboardInterrupt) else error.kind
        error = error.__cause__
    return Kind.UNKNOWN


def is_retryable(error: BaseException) -> bool:
    return kind_of(error) in (Kind.THROTTLED, Kind.TRANSIENT)


def kind_of_status(status: int) -> Kind:
    """The kind of an HTTP status."""
    named = {404: Kind.NOT_FOUND, 412: Kind.ALREADY_EXISTS, 409: Kind.TRANSIENT, 403: Kind.PERMISSION, 416: Kind.INVALID, 429: Kind.THROTTLED, 503: Kind.THROTTLED}
    if status in named:
        return named[status]
    if 500 <= status < 600:
        return Kind.TRANSIENT
    return Kind.INVALID if 400 <= status < 500 else Kind.UNKNOWN


def kind_of_os(error: OSError) -> Kind:
    named = {errno.ENOENT: Kind.NOT_FOUND, errno.EEXIST: Kind.ALREADY_EXISTS, errno.EACCES: Kind.PERMISSION, errno.EPERM: Kind.PERMISSION, errno.EINVAL: Kind.INVALID, errno.ENAMETOOLONG: Kind.INVALID}
    return named.get(error.errno, Kind.TRANSIENT)
