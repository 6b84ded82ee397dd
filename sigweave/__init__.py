"""Spark jobs for multichannel biosignal recordings."""
