"""Lagged causal discovery: lag frames, independence tests, the PCMCI family, and link tables."""
