"""Signals from inside the process: sent at once, or waited for until the state that holds them is stored."""

from __future__ import annotations

import queue
import threading
from dataclasses import dataclass, field


@dataclass
class Pending:
    id: str
    type: str
    data: str
    stored: threading.Event = field(default_factory=threading.Event)


class SignalQueue:
    def __init__(self, capacity: int = 1_024):
        self.waiting: queue.Queue[Pending] = queue.Queue(capacity)
        self.taken: list[Pending] = []

    def send(self, signal_id: str, kind: str, data: str = "{}") -> Pending:
        p = Pending(signal_id, kind, data)
        self.waiting.put_nowait(p)
        return p

    def send_and_wait(self, signal_id: str, kind: str, data: str = "{}", timeout: float | None = None) -> bool:
        """Whether the signal's effect was stored in time."""
        return self.send(signal_id, kind, data).stored.wait(timeout)

    def take(self) -> list[Pending]:
        """Signals to handle in this batch."""
        out = []
        while True:
            try:
                out.append(self.waiting.get_nowait())
            except queue.Empty:
                break
        self.taken += out
        return out

    def acknowledge(self, *_) -> None:
        """Called after the checkpoint: those who wait go on."""
        for p in self.taken:
            p.stored.set()
        self.taken = []
