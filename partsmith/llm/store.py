"""A bounded store of values by key, in two generations: when the young one is full it becomes the old one."""

from __future__ import annotations

from collections.abc import Callable


class Store:
    """At most twice ``most`` keys of at most ``longest`` characters; what is asked for again moves to the young generation."""

    def __init__(self, learn: Callable[[list], list], most: int = 300_000, longest: int = 64):
        self.learn, self.most, self.longest = learn, most, longest
        self.young: dict = {}
        self.old: dict = {}

    def values(self, keys: list) -> list:
        got = list(map(self.young.get, keys))
        missing = [i for i, g in enumerate(got) if g is None]
        if missing:
            wanted = {keys[i] for i in missing}
            found = {k: self.old[k] for k in wanted if k in self.old}
            new = [k for k in wanted if k not in found]
            if new:
                found.update(zip(new, self.learn(new)))
            for i in missing:
                got[i] = found[keys[i]]
            if len(self.young) + len(found) > self.most:
                self.old, self.young = self.young, {}
            self.young.update((k, v) for k, v in found.items() if len(k) <= self.longest)
        return got
