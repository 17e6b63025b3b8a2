"""Readers and writers: file trees, probes, manifests, derived files."""
