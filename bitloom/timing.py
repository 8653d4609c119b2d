"""Scope timers and logging."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger("bitloom")

#: Environment names: the log level, and whether timings are logged.
LOG_ENV, TIMING_ENV = "BITLOOM_LOG", "BITLOOM_TIMING"


def init_logging(level: str | None = None, file: str | None = None) -> None:
    """Log to standard error, or to ``file``, at ``level`` or the one in the environment."""
    handler = logging.FileHandler(file) if file else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    log.addHandler(handler)
    log.setLevel((level or os.environ.get(LOG_ENV, "INFO")).upper())


@contextmanager
def timed(what: str, level: int = logging.INFO) -> Iterator[None]:
    """Log how long the scope took, if timings are wanted."""
    began = time.perf_counter()
    try:
        yield
    finally:
        if os.environ.get(TIMING_ENV):
            log.log(level, "%s: %.3f s", what, time.perf_counter() - began)
