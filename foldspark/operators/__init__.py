"""How projections are folded, joined and run."""
