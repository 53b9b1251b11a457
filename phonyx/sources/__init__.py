"""Readers and writers of the recorded data: segments, predictions, cues, spans, passes, gauges and manifests."""
