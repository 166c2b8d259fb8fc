"""The registered queries: test tables mapped to the library's inputs, one query per operator, and the
independent SQL for each."""
