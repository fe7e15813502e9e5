"""Intermediate tables in the folder that all executors share, under the names this subpackage uses."""

from __future__ import annotations

from ..operators._shared import clean_up, drop, new_path, only_kept, shared_dir
from ..operators._shared import written as materialise

__all__ = ["clean_up", "drop", "materialise", "new_path", "only_kept", "shared_dir"]
