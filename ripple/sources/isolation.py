"""
Calls in a child process: what crashes, hangs or exhausts its process costs one answer, not the task. One child serves many calls; after a death or a time
limit the next call gets a new one.
"""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable
from multiprocessing.connection import Connection
from typing import Any

_FORK = multiprocessing.get_context("fork")


def _serve(f: Callable, end: Connection) -> None:
    while True:
        try:
            args: list[tuple] = end.recv()
        except EOFError:
            return
        for each in args:
            end.send(f(*each))


class Isolated:
    """``f`` in a child process; None for a call that raises, kills its process or takes longer than ``seconds``. To be used in a with block."""

    def __init__(self, f: Callable, seconds: float):
        self.f, self.seconds, self.child, self.end, self.started = f, seconds, None, None, 0

    def __call__(self, *args) -> Any:
        return self.each([args])[0]

    def each(self, calls: list[tuple]) -> list:
        """The answers of many calls, which are sent at once; each has ``seconds`` of its own, and a call that ends the child costs its own answer only."""
        out: list = []
        while len(out) < len(calls):
            if self.child is None:
                self.end, other = _FORK.Pipe()
                self.child = _FORK.Process(target=_serve, args=(self.f, other), daemon=True)
                self.child.start()
                other.close()  # the child's death then ends the connection
                self.started += 1
            try:
                self.end.send(calls[len(out) :])
                while len(out) < len(calls) and self.end.poll(self.seconds):
                    out.append(self.end.recv())
            except (EOFError, OSError):
                pass
            if len(out) < len(calls):
                self.close()
                out.append(None)
        return out

    def close(self) -> None:
        if self.child is not None:
            self.end.close()
            self.child.kill()
            self.child.join()
            self.child = None

    def __enter__(self) -> Isolated:
        return self

    def __exit__(self, *_) -> None:
        self.close()
