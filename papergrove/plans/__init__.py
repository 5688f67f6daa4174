"""Whole simulations and the registered queries."""
