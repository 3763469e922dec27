"""Readers of run documents and side files; writers of exports."""
