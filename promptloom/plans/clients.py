"""Clients for trying out inference without an endpoint."""

from __future__ import annotations

from promptloom.operators.infer import PermanentError, Request, Response, RetryableError


class EchoClient:
    """Answers with the prompt and counts words as tokens; prompts with the text ``refuse`` fail for good."""

    def __init__(self, refuse: str | None = None) -> None:
        self.refuse = refuse

    def complete(self, request: Request) -> Response:
        if self.refuse is not None and self.refuse in request.prompt:
            raise PermanentError("refused")
        answer = f"echo: {request.prompt}"
        return Response(answer, len(request.prompt.split()), len(answer.split()))


class FlakyClient:
    """Reads from the prompt's last word how often it must fail before it answers."""

    def complete(self, request: Request) -> Response:
        word = request.prompt.rsplit(" ", 1)[-1]
        if word == "refuse":
            raise PermanentError("refused")
        if word == "crash":
            raise ValueError("boom")
        if request.attempt <= int(word):
            raise RetryableError(f"busy {request.attempt}")
        return Response(None, None, None)
