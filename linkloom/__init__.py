"""Relational-network analytics and corpus preparation on Spark."""
