"""Slices that arrive one by one: the depth projection and the focus profile as running state."""
