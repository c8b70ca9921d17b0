"""Recognisers for programming languages: lexers, grammars, and a generalised LL engine over bracket-folded tokens."""
