"""Runs of steps that can be taken up again: a ledger of the steps each run has finished.

A run belongs to a day. It is open until its last step is done; starting again on a day
with an open run goes on with the first step that is not marked. Marks are empty files
below the store's root, made after a step has returned, so a step that broke off is run
again. All steps leave the tables as they are when run twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from stockloom.sinks.warehouse import Warehouse

_CLOSED = "_closed"


class Run:
    """The open run of a day, or a new one."""

    def __init__(self, store: Warehouse, day: dt.date):
        self.store = store
        self.folder = f"{store.root}/_runs/{day.isoformat()}"
        numbers = [int(n) for n in self._names(self.folder) if n.isdigit()]
        last = max(numbers, default=0)
        self.resumed = last > 0 and _CLOSED not in self._names(f"{self.folder}/{last}")
        self.number = last if self.resumed else last + 1

    def _names(self, path: str) -> list[str]:
        files, folder = self.store._folder(path)
        return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []

    def finished(self) -> set[str]:
        return set(self._names(f"{self.folder}/{self.number}"))

    def mark(self, step: str) -> None:
        files, path = self.store._folder(f"{self.folder}/{self.number}/{step}")
        files.create(path, True).close()

    def go(self, steps: Sequence[tuple[str, Callable[[], None]]]) -> list[str]:
        """Runs the steps not finished yet, in order, and closes the run; the names of those it ran."""
        done, ran = self.finished(), []
        for name, step in steps:
            if name not in done:
                step()
                self.mark(name)
                ran.append(name)
        self.mark(_CLOSED)
        return ran
