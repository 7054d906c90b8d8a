"""Learners: each lap is one Spark job over the data; only model-sized results return."""
