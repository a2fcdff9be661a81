"""Errors with the status that the API answers."""

from __future__ import annotations


class SearchError(Exception):
    status = 400

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.message = message
        if status is not None:
            self.status = status

    def as_dict(self) -> dict:
        return {"success": False, "message": self.message}


class QueryError(SearchError):
    """A query, filter, aggregation or setting that makes no sense."""


class NotFound(SearchError):
    status = 404


class Forbidden(SearchError):
    status = 403
