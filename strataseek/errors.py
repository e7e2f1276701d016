"""Errors with a code, and the envelope that callers see."""

from __future__ import annotations


class StoreError(RuntimeError):
    """Base of all errors of the store; ``code`` names the kind, ``retryable`` says whether a later try may work."""

    code = "storage_error"
    retryable = False


class WriterBusy(StoreError):
    code, retryable = "writer_busy", True


class OperationConflict(StoreError):
    code = "operation_id_conflict"


class GenerationConflict(StoreError):
    code = "generation_conflict"


class NotPublished(StoreError):
    code = "generation_not_published"


class NotFound(StoreError):
    code = "not_found"


class InvalidCursor(StoreError):
    code = "invalid_cursor"


class CursorExpired(InvalidCursor):
    code = "cursor_expired"


class DeadlineExceeded(StoreError):
    code, retryable = "query_deadline_exceeded", True


class SchemaMismatch(StoreError):
    code = "schema_mismatch"


def envelope(call):
    """Result of ``call`` as a dict; errors become status and errorcode."""
    try:
        return {"errorcode": None, **call()}
    except StoreError as e:
        return {"status": "error", "errorcode": e.code, "message": str(e), "retryable": e.retryable}
    except ValueError as e:
        return {"status": "error", "errorcode": getattr(e, "code", "invalid_request"), "message": str(e), "retryable": False}
