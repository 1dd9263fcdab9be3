"""Many path globs at once: one automaton over path segments, run once for each path."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


class GlobSet:
    """Globs for whole paths (`*` one whole segment, `**` any number of them), numbered in order, as a tree of their segments.

    A path is read segment by segment with the set of places in the tree that it can
    be at; globs that begin alike share their places.
    """

    def __init__(self, globs: Iterable[str]):
        self.following: list[dict[str, int]] = [{}]  # by literal segment
        self.any_one: list[int | None] = [None]
        self.any_number: list[int | None] = [None]
        self.loops: list[bool] = [False]
        self.ends: list[list[int]] = [[]]
        for number, glob in enumerate(globs):
            at = 0
            for part in glob.split("/"):
                kind = {"*": self.any_one, "**": self.any_number}.get(part)
                to = self.following[at].get(part) if kind is None else kind[at]
                if to is None:
                    to = self._place(loops=part == "**")
                    if kind is None:
                        self.following[at][part] = to
                    else:
                        kind[at] = to
                at = to
            self.ends[at].append(number)

    def _place(self, loops: bool) -> int:
        self.following.append({})
        self.any_one.append(None)
        self.any_number.append(None)
        self.loops.append(loops)
        self.ends.append([])
        return len(self.ends) - 1

    def _with_none(self, places: set[int]) -> set[int]:
        """With the places that `**` reaches without a segment."""
        todo = list(places)
        while todo:
            to = self.any_number[todo.pop()]
            if to is not None and to not in places:
                places.add(to)
                todo.append(to)
        return places

    def matching(self, path: str) -> list[int]:
        """The numbers of the globs that the path fits, in order."""
        places = self._with_none({0})
        for segment in path.split("/"):
            step: set[int] = set()
            for p in places:
                if self.loops[p]:
                    step.add(p)
                if self.any_one[p] is not None:
                    step.add(self.any_one[p])
                if segment in self.following[p]:
                    step.add(self.following[p][segment])
            places = self._with_none(step)
            if not places:
                return []
        return sorted({n for p in places for n in self.ends[p]})


def path_rules(paths: DataFrame, sides: dict[str, list[str | None]]) -> DataFrame:
    """(path, a column for each side): of paths (path) the numbers of the globs that each fits; None is no glob."""
    sets = {}
    for side, globs in sides.items():
        numbers: dict[str, list[int]] = {}
        for k, glob in enumerate(globs):
            if glob is not None:
                numbers.setdefault(glob, []).append(k)
        sets[side] = GlobSet(numbers), list(numbers.values())

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            columns = [pa.array([sorted(k for n in globs.matching(p) for k in numbers[n]) for p in own], pa.list_(pa.int32())) for globs, numbers in sets.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["path", *sets])

    return paths.select("path").filter("path IS NOT NULL").distinct().mapInArrow(fit, "path string, " + ", ".join(f"`{s}` array<int>" for s in sets))
