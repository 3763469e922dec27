"""Answers of the query side as plain dictionaries: what was asked for, or what went wrong and what to do about it."""

from __future__ import annotations

from collections.abc import Callable

#: What an answer's error may be, with the advice that goes with it.
HINTS = {
    "no_dataset": "Import run documents first, or name a folder that holds the tables.",
    "invalid_argument": "Correct the argument that the message names.",
    "not_found": "Ask for the ids that the dataset has.",
    "unreadable": "Mend or remove the file that the message names.",
    "busy": "Wait until the other import has ended.",
    "failed": "",
}


class QueryError(Exception):
    """An error with one of the codes of HINTS."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code if code in HINTS else "failed"


def failure(error: Exception) -> dict:
    """ok, error, message and hint of an exception."""
    code = error.code if isinstance(error, QueryError) else "no_dataset" if isinstance(error, FileNotFoundError) else "invalid_argument" if isinstance(error, ValueError) else "failed"
    return {"ok": False, "error": code, "message": str(error), "hint": HINTS[code] or None}


def answer(question: Callable[..., dict | None], *args: object, **kwargs: object) -> dict:
    """The result of question with ok = True, or its failure; only programming errors pass through."""
    try:
        return {"ok": True, **(question(*args, **kwargs) or {})}
    except (QueryError, OSError, ValueError) as e:
        return failure(e)
