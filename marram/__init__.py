"""Governed web analytics on Spark."""
