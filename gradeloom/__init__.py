"""Exam analytics on Spark."""
