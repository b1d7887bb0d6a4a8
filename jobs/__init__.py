"""Runnable jobs: `python -m jobs.note_phenotypes`, `python -m jobs.association_release`."""
