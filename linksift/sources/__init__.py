"""Readers, writers and the labelled-link table builder."""
