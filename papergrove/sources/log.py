"""The log of a run: lines with a level and the time since its start."""

from __future__ import annotations

import time
from typing import TextIO

#: Levels, from the one that is always written; and the marks of lines.
ERROR, INFO, DEBUG = -1, 0, 1
MARKS = {INFO: "[INFO]", DEBUG: "[DEBUG]", ERROR: "[ERROR]"}

#: Lines of the program that scripts look for in its log.
LOADED, GROWN, FINISHED, WROTE = "loaded graph", "final graph size is {}", "finished sim", "wrote graph"
TOOK = "E2E time for {} cycles with growth rate {:g} % = {} seconds"


def prefix(level: int, seconds: float) -> str:
    """[LEVEL][d-h:m:s](t=Ns) of whole seconds."""
    s = int(seconds)
    return f"{MARKS[level]}[{s // 86400}-{s // 3600 % 24}:{s // 60 % 60}:{s % 60}](t={s}s)"


class Log:
    """Writes lines up to a level to a text file, each at once."""

    def __init__(self, out: TextIO, level: int):
        self.out, self.level, self.began = out, level, time.monotonic()

    def __call__(self, text: str, level: int = INFO) -> None:
        if self.level >= level:
            print(prefix(level, time.monotonic() - self.began), text, file=self.out, flush=True)
