"""Streaming extensions; the batch semantics stay the ones to match."""
