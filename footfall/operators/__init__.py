"""Keyed folds, sessions, goals, funnels, distinct counting and maintenance."""
