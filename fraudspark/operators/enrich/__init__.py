"""Signals and additive risk scores for e-mail, IP, phone, card and device data."""
