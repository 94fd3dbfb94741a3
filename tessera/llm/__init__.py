"""Training-data corpus operators. Nothing outside this subpackage imports it."""
