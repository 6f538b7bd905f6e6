"""DataFrame -> DataFrame operators, meant for ``DataFrame.transform``."""
