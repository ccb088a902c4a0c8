"""Operators for training-data corpora, and their queries."""

from __future__ import annotations
