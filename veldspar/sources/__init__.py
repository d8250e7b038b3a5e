"""Frames in and out."""
