"""Plans put together from the operators: text reports, the evaluation of distances, and the command line."""
