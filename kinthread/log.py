"""Logging of the package."""

from __future__ import annotations

import logging

LOGGER = logging.getLogger("kinthread")
_ready = False


def setup_logger(level: int | str = "INFO") -> logging.Logger:
    """Set the level and, the first time only, a handler."""
    global _ready
    LOGGER.setLevel(level)
    if not _ready:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        LOGGER.addHandler(handler)
        _ready = True
    return LOGGER
