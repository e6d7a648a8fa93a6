"""Readers and writers; every reader takes an explicit schema."""
