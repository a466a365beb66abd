"""Artifact inventory and risk analytics over tables of files and texts, on Spark."""
