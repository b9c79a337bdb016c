"""Errors that the engine raises."""


class EngineError(Exception):
    """Base of all errors; ``status`` is what the request dispatcher answers."""

    status = 500
    prefix = "error"

    def __str__(self) -> str:
        return f"{self.prefix}: {super().__str__()}"


class NotFoundError(EngineError):
    status = 404
    prefix = "not found"


class StorageError(EngineError):
    prefix = "storage error"


class QueryError(EngineError):
    status = 400
    prefix = "query error"


class TemporalError(EngineError):
    prefix = "temporal error"


class NotImplementedYetError(EngineError):
    prefix = "unimplemented"
