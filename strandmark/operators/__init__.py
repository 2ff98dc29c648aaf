from . import reads, sequence, variants

__all__ = ["reads", "sequence", "variants"]
