"""Whole jobs: the log set, session settings, shared folder and registered queries."""
