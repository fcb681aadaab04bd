"""Readers and writers of keyed text tables, vectors, waveforms and shards."""
