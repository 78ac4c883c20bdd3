"""Readers, writers and the rule table."""
