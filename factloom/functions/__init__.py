"""Expressions: canonical JSON, digests, instants, fingerprints, deterministic ids."""
