"""Following detections over time."""
