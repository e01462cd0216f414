"""The same steps over a stream of captures."""
