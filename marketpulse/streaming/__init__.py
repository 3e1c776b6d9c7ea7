"""Micro-batch forms."""
