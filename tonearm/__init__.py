"""Tonearm: media-library catalog cleaning and duplicate analysis as Spark jobs."""
