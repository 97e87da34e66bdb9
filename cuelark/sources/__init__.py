"""Readers and writers of subtitle, scene, segment and reply files."""
