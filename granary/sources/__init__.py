"""Readers and writers. Inputs are read through Spark alone, so any store that Spark reaches will do."""
