"""Calls of a slow client, several at a time and each with a deadline, inside a task."""

from __future__ import annotations

import heapq
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice


@dataclass(frozen=True)
class CallPolicy:
    """window: calls at a time in a task. deadline: seconds for one call (None: any). retries: further calls after one
    that failed, the first after `backoff` seconds, each next after twice as long. interval: least seconds between two
    calls of a task.

    A call that overran its deadline cannot be stopped; it is left alone, and its place is free for another.
    """

    window: int = 8
    deadline: float | None = None
    retries: int = 0
    backoff: float = 0.5
    interval: float = 0.0


#: Paths that wait for their call, for each call at a time.
AHEAD = 50
#: Results that end the wait for more of them.
TOGETHER = 256
Result = tuple[str | None, str | None]


class Calls:
    """Runs the calls of a list of paths, failures as text.

    As many threads as calls at a time take path after path. One whose call overran its deadline is replaced, and ends
    when its call does.
    """

    def __init__(self, make_client: Callable[[], Callable[[str], str]], policy: CallPolicy):
        self.make_client, self.policy = make_client, policy
        self.idle: list[Callable[[str], str]] = []
        lock = threading.Lock()
        self.work, self.news = threading.Condition(lock), threading.Condition(lock)  # for the threads, for the reader
        self.todo: deque[tuple[int, str]] = deque()
        self.again: list[tuple[float, int, int, str]] = []  # when, place, attempt, path
        self.flying: dict[tuple[int, int], tuple[float, str]] = {}  # (place, attempt): when it must end, path
        self.ended: list[tuple[int, str | None, str | None]] = []
        self.next_start, self.closed = 0.0, False

    def call(self, client: Callable[[str], str] | None, path: str) -> tuple[Callable[[str], str] | None, Result]:
        try:
            client = client or self.make_client()
            return client, (client(path), None)
        except Exception as e:  # noqa: BLE001 - whatever the client raises is the image's failure
            return client, (None, f"{type(e).__name__}: {e}"[:200])

    def end(self, place: int, attempt: int, path: str, out: Result) -> None:
        if out[1] is not None and attempt < self.policy.retries:
            heapq.heappush(self.again, (time.monotonic() + self.policy.backoff * 2**attempt, place, attempt + 1, path))
            self.work.notify()
        else:
            self.ended.append((place, *out))
            if len(self.ended) >= TOGETHER or not (self.todo or self.again):
                self.news.notify()

    def overran(self) -> Result:
        return None, f"TimeoutError: no reply within {self.policy.deadline} seconds"

    def take(self) -> tuple[int, int, str] | None:
        """The next call, once there is one; None at the end. Retries that are due come first."""
        while not self.closed:
            if self.again and self.again[0][0] <= time.monotonic():
                return heapq.heappop(self.again)[1:]
            if self.todo:
                place, path = self.todo.popleft()
                return place, 0, path
            self.news.notify()
            self.work.wait(max(0.0, self.again[0][0] - time.monotonic()) if self.again else None)
        return None

    def serve(self) -> None:
        """A thread: a client belongs to one call at a time; a call that never ends keeps its own."""
        client = None
        while True:
            with self.work:
                found = self.take()
                if found is None:
                    return
                place, attempt, path = found
                now = time.monotonic()
                begin = max(now, self.next_start)
                self.next_start = begin + self.policy.interval
                limit = begin + self.policy.deadline if self.policy.deadline else float("inf")
                self.flying[place, attempt] = limit, path
                if client is None and self.idle:
                    client = self.idle.pop()
            if begin > now:
                time.sleep(begin - now)
            client, out = self.call(client, path)
            with self.work:
                if self.flying.pop((place, attempt), None) is None:  # another thread has taken over
                    if client is not None:
                        self.idle.append(client)
                    return
                self.end(place, attempt, path, self.overran() if time.monotonic() > limit else out)

    def drop_overdue(self) -> float | None:
        """Ends the calls over their deadline; seconds until the next deadline."""
        if not self.policy.deadline:
            return None
        now = time.monotonic()
        for (place, attempt), (limit, path) in list(self.flying.items()):
            if limit <= now:
                del self.flying[place, attempt]
                self.end(place, attempt, path, self.overran())
                threading.Thread(target=self.serve, daemon=True).start()
        return max(0.0, min((limit for limit, _ in self.flying.values()), default=now + self.policy.deadline) - now)

    def as_they_end(self, paths: Iterable[str]) -> Iterator[tuple[int, str | None, str | None]]:
        """Place, reply and failure of each path, one of the two null, whichever call ends first: none waits for another's."""
        policy = self.policy
        if policy.window == 1 and not policy.deadline and not policy.retries:  # nothing to wait for beside the call
            client = None
            for place, path in enumerate(paths):
                if self.next_start > time.monotonic():
                    time.sleep(max(0.0, self.next_start - time.monotonic()))
                self.next_start = time.monotonic() + policy.interval if policy.interval else 0.0
                client, (reply, failure) = self.call(client, path)
                yield place, reply, failure
            return
        source, given, taken, more = iter(paths), 0, 0, True
        for _ in range(policy.window):
            threading.Thread(target=self.serve, daemon=True).start()
        try:
            while more or given < taken:
                if more and len(self.todo) < AHEAD * policy.window / 2:
                    new = list(islice(source, AHEAD * policy.window // 2))
                    more = bool(new)
                    with self.work:
                        self.todo.extend(enumerate(new, taken))
                        taken += len(new)
                        self.work.notify_all()
                with self.news:
                    until = self.drop_overdue()
                    idle = more and not self.todo
                    if given < taken and not self.ended and not idle:
                        self.news.wait(until)
                    out, self.ended = self.ended, []
                given += len(out)
                yield from out
        finally:
            with self.work:
                self.closed = True
                self.work.notify_all()

    def run(self, paths: Iterable[str]) -> Iterator[Result]:
        """Reply and failure of each path, one of them null, in the order of the paths; early ones are held."""
        held: dict[int, Result] = {}
        given = 0
        for place, *out in self.as_they_end(paths):
            held[place] = tuple(out)
            while given in held:
                yield held.pop(given)
                given += 1
