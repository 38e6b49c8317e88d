"""Plans: experiments as compositions of operators, and the registered queries."""
