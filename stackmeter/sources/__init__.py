"""Scans: frames, group files, discovery of stacks, finished runs, result tables."""
