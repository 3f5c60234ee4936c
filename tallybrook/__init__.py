"""Tallybrook: case-flow analytics on Spark."""
