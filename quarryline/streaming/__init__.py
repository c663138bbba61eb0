"""Streams: the same transformations on ``readStream`` frames and on batches."""
