"""Plans: whole pipelines made of the operators, and the queries registered for them."""
