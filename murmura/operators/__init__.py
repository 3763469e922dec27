"""Relational operators over runs, items, sightings, labels and exclusions."""
