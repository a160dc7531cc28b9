"""Input derivations, named queries and their SQL oracles."""
