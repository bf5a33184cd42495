"""Saves of something that keeps changing: one at a time, those asked for meanwhile as one."""

from __future__ import annotations

import threading
from collections.abc import Callable


class Saves:
    """Runs write() after it was asked to, in a thread of its own, and never twice at a time.

    Every ask is covered by a write that began after it; however many come while
    one runs, one more follows. A write that fails is told at the next flush, and
    the asks that it was for are kept for the next one.
    """

    def __init__(self, write: Callable[[], object], wait: float = 0.0):
        self.write, self.wait = write, wait
        self.changed = threading.Condition()
        self.asked = self.saved = self.runs = 0
        self.error: BaseException | None = None
        self.running = self.closed = False

    def ask(self) -> None:
        with self.changed:
            if self.closed:
                raise RuntimeError("no saves after close")
            self.asked += 1
            if not self.running:
                self.running = True
                threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        while True:
            with self.changed:
                if self.wait and not self.closed:
                    self.changed.wait(self.wait)  # for more asks, unless all is to be written at once
                upto = self.asked
            try:
                self.write()
                failed = None
            except BaseException as error:  # told by flush()
                failed = error
            with self.changed:
                self.runs += 1
                self.error = failed
                if failed is None:
                    self.saved = max(self.saved, upto)
                self.running = failed is None and self.saved < self.asked
                self.changed.notify_all()
                if not self.running:
                    return

    def flush(self, timeout: float | None = None) -> None:
        """Waits until all that was asked for is written; raises what a write failed with, having tried once more."""
        with self.changed:
            if self.saved < self.asked and not self.running:
                self.running = True
                threading.Thread(target=self._run, daemon=True).start()
            if not self.changed.wait_for(lambda: not self.running, timeout):
                raise TimeoutError("a save is still running")
            if self.saved < self.asked and self.error is not None:
                raise self.error

    def close(self) -> None:
        with self.changed:
            self.closed = True
            self.changed.notify_all()
        self.flush()
