"""The tables that cut lineage, shared with the rest of the library."""

from strandline.sources.scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
