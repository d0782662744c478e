"""Column functions: text, probabilities, arrays and hashing. All of them are expressions Catalyst can plan."""
