"""Flows that combine operators: ingestion, grounded answers, recommendations, reports."""
