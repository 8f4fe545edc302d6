"""Retail-banking analytics as Spark jobs: warehouse loads, marts, features and recommendations."""
