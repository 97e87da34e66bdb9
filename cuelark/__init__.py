"""Subtitle and speech-timeline analytics on Spark DataFrames."""
