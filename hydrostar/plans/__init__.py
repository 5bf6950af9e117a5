"""Query plans: base queries (Q1-Q11), derived results (P1-P26), registry."""
