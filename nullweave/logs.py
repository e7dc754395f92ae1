"""Logging to the console and a rotating file."""

from __future__ import annotations

import logging
import logging.handlers
import os


def configure_logging(log_dir: str | None = None, console: bool = True, level: str = "INFO") -> logging.Logger:
    """The package's logger: 5 MB files, 30 of them kept."""
    log = logging.getLogger("nullweave")
    log.setLevel(level)
    for h in list(log.handlers):
        log.removeHandler(h)
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    handlers: list[logging.Handler] = [logging.StreamHandler()] if console else []
    if log_dir:
        os.makedirs(log_dir, exist_ok=True)
        handlers.append(logging.handlers.RotatingFileHandler(os.path.join(log_dir, "nullweave.log"), maxBytes=5_000_000, backupCount=30))
    for h in handlers:
        h.setFormatter(form)
        log.addHandler(h)
    return log
