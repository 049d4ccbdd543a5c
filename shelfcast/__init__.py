"""Retail sales analytics and forecasting as Spark DataFrame jobs."""
