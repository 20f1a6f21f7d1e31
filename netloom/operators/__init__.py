"""Operators on graphs, auctions and bandits."""
