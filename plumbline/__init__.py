"""Plumbline: curation, auditing and evaluation of annotated point sets on Spark."""
