"""Whole extractions: settings, providers, and the plan from blocks to units."""
