"""Part of the exam analytics engine."""
