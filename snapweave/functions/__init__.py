"""Part of snapweave."""
