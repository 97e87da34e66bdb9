"""Operators on cue, segment, scene and prediction tables."""
