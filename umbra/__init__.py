"""Privacy, code-check and audit analytics over large text tables, as ordinary Spark plans."""
