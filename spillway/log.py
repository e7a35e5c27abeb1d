"""Logging and timers of runs."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager

LOG = logging.getLogger("spillway")


def configure(path: str | None = None, level: int = logging.INFO) -> None:
    """Messages go to the error stream and, with a path, are added to that file too."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(logging.FileHandler(path, mode="a"))
    for h in handlers:
        h.setFormatter(logging.Formatter("[%(asctime)s][%(threadName)s][%(levelname).3s]: %(message)s"))
    LOG.handlers[:] = handlers
    LOG.setLevel(level)


@contextmanager
def timed(what: str):
    """Log how long the block took."""
    began = time.perf_counter()
    try:
        yield
    finally:
        LOG.info("%s: %.0f ms", what, 1000 * (time.perf_counter() - began))
