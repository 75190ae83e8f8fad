"""Streams as a graph of temporal operators, lowered to DataFrames or stepped tick by tick."""
