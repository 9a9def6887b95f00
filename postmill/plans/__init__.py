"""Planning an archive: names that are unique and fit, and the check of a plan."""
