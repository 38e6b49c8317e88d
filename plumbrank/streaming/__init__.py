"""Deliberately empty: experiments are batch jobs over a fixed corpus and fixed labels, and no operator here has a streaming form."""
