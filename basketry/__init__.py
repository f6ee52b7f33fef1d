"""Basket, graph, text, dose, risk and evidence analytics as PySpark DataFrame operators."""
