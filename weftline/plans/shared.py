"""The shared folder, under its older name."""

from weftline.shared import drop, shared_dir

__all__ = ["drop", "shared_dir"]
