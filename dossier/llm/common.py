"""What the training-data operators share."""

from __future__ import annotations

from dossier.operators.broadcasts import bounded_broadcast
from dossier.sources.shared import cut, remove_tables, shared_dir, shared_path, spread

__all__ = ["MAX_TASKS", "WORD", "bounded_broadcast", "cut", "remove_tables", "shared_dir", "shared_path", "spread"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Tasks that files are dealt to, at most.
MAX_TASKS = 10_000
