"""Plans: the registered queries, each with SQL of the same result where SQL has one."""
