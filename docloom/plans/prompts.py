"""Prompt texts of a model behind a router, by name from a folder."""

from __future__ import annotations

from pathlib import Path


def load_prompt(folder: str, name: str) -> str:
    """The text of ``name.txt``; a missing one is a FileNotFoundError.  Read on the driver."""
    path = Path(folder, f"{name}.txt")
    if not path.is_file():
        raise FileNotFoundError(f"no prompt {name!r} in {folder}")
    return path.read_text(encoding="utf-8")
