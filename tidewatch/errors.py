"""Errors with the codes and statuses of the read interface."""

from __future__ import annotations


class ServiceError(RuntimeError):
    code, status = "request_error", 400

    def envelope(self) -> dict:
        return {"error": {"code": self.code, "message": str(self)}}


class NotFound(ServiceError):
    status = 404


class InvalidRequest(ServiceError):
    code, status = "validation_error", 422


class ArtifactUnavailable(ServiceError):
    code, status = "artifact_unavailable", 503


class GateError(RuntimeError):
    """An integrity gate of a build did not hold."""
