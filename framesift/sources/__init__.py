"""Readers and writers of image folders, captions and JSON records."""
