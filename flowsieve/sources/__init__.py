"""Readers of captures, snapshots and stored documents."""
