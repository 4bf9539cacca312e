"""Readers and writers; each parser also takes a DataFrame of raw ``value`` rows."""
