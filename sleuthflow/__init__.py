"""Fraud analytics as Spark jobs: every entity, company and case in one distributed run."""
