"""Runnable jobs: python -m jobs.detect_arrivals, python -m jobs.collection_report. See the README."""
