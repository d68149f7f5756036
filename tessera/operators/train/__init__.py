"""Trainers: a distributed count, then a greedy or iterative loop over distinct pretokens."""
