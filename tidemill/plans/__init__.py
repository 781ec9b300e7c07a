"""Chains of steps and their compilation."""
