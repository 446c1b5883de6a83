"""Frames, evidence documents and archives in; results out."""
