"""Column functions: text, measures, links.  Column in, Column out; no joins."""
