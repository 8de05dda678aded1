"""Readers and writers for tasks, verdict archives, chat rows and telemetry."""
