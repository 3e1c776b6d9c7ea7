"""Landed platform responses to posts."""
