"""Readers and writers of slide folders, tile stores, images, annotations and projects."""
