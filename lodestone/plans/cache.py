"""Answers that are kept for a while on the driver, and work that does not run twice at once."""

from __future__ import annotations

import json
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

#: Entries and seconds that answers are kept.
ANSWERS, ANSWER_SECONDS = 64, 30.0


class AnswerCache:
    """The answers that were asked for last, each for a limited time; small ones, as they are held on the driver."""

    def __init__(self, most: int = ANSWERS, seconds: float = ANSWER_SECONDS, clock: Callable[[], float] = time.time):
        self.most, self.seconds, self.clock = most, seconds, clock
        self._held: OrderedDict[str, tuple[float, Any]] = OrderedDict()
        self._lock = threading.Lock()

    @staticmethod
    def key(kind: str, **arguments: Any) -> str:
        return f"{kind}:{json.dumps(arguments, sort_keys=True)}"

    def __len__(self) -> int:
        return len(self._held)

    def __contains__(self, key: str) -> bool:
        with self._lock:
            return self._fresh(key)

    def _fresh(self, key: str) -> bool:
        if key in self._held and self.clock() - self._held[key][0] > self.seconds:
            del self._held[key]
        return key in self._held

    def get(self, key: str, default: Any = None) -> Any:
        with self._lock:
            if not self._fresh(key):
                return default
            self._held.move_to_end(key)
            return self._held[key][1]

    def put(self, key: str, value: Any) -> None:
        with self._lock:
            self._held.pop(key, None)
            while len(self._held) >= self.most:
                self._held.popitem(last=False)
            self._held[key] = self.clock(), value

    def clear(self) -> None:
        """To be called when the code base has changed."""
        with self._lock:
            self._held.clear()

    def answer(self, kind: str, make: Callable[[], Any], **arguments: Any) -> Any:
        """The kept answer, else the one that make gives."""
        key, nothing = self.key(kind, **arguments), object()
        value = self.get(key, nothing)
        if value is nothing:
            value = make()
            self.put(key, value)
        return value

    def dump(self) -> str:
        """The entries as JSON, to be kept between sessions."""
        with self._lock:
            return json.dumps({"version": 1, "entries": [[k, t, v] for k, (t, v) in self._held.items()]})

    def load(self, text: str) -> None:
        """Takes back what dump gave, but for what is too old or can't be read."""
        try:
            data = json.loads(text)
        except ValueError:
            return
        for key, stamp, value in data["entries"] if isinstance(data, dict) and data.get("version") == 1 else []:
            if self.clock() - stamp <= self.seconds and len(self._held) < self.most:
                self._held[key] = stamp, value


class OneAtATime:
    """Work that never runs twice at once: being asked for again meanwhile makes it run once more afterwards."""

    def __init__(self, work: Callable[[], None]):
        self.work = work
        self._lock = threading.Lock()
        self._running = self._again = False

    def ask(self) -> bool:
        """Runs the work; False if it is running already, and will run again."""
        with self._lock:
            if self._running:
                self._again = True
                return False
            self._running = True
        try:
            while True:
                self.work()
                with self._lock:
                    if not self._again:
                        self._running = False
                        return True
                    self._again = False
        except BaseException:
            with self._lock:
                self._running = self._again = False
            raise
