"""Recipes, their planning, and the registered queries."""
