"""Workloads, their log, and the registered queries."""
