"""Durable results: outputs, manifests, verification."""
