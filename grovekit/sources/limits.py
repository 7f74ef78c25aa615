"""Rate limits and retries for sources that ask a service."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable


class RateLimit:
    """At most ``calls`` entries into the context within any ``seconds``; others wait their turn."""

    def __init__(self, calls: int, seconds: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.calls, self.seconds, self.clock, self.sleep = calls, seconds, clock, sleep
        self.past: deque[float] = deque()
        self.lock = threading.Lock()

    def __enter__(self) -> "RateLimit":
        while True:
            with self.lock:
                now = self.clock()
                while self.past and self.past[0] <= now - self.seconds:
                    self.past.popleft()
                if len(self.past) < self.calls:
                    self.past.append(now)
                    return self
                wait = self.past[0] + self.seconds - now
            self.sleep(wait)

    def __exit__(self, *exc) -> None:
        return None


def retried(call: Callable, tries: int = 3, sleep: Callable[[float], None] = time.sleep):
    """``call()`` up to ``tries`` times, after 1, 2, 4 .. seconds; the last error is raised."""
    for i in range(tries):
        try:
            return call()
        except Exception:  # noqa: BLE001
            if i == tries - 1:
                raise
            sleep(2**i)
    raise ValueError("tries must be at least 1")
