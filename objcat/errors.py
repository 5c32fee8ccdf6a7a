"""Refusals: a request that could only give a wrong or unsafe answer is raised, never guessed at."""

from __future__ import annotations


class Refused(ValueError):
    """The request cannot be honoured as stated."""


class PatternError(Refused):
    """A glob that does not mean anything; `position` counts characters from 1."""

    def __init__(self, pattern: str, position: int, problem: str):
        super().__init__(f"pattern {pattern!r}: {problem} at position {position}")
        self.pattern, self.position, self.problem = pattern, position, problem
