"""Plans that combine operators: the analysis run, its rules and reports."""
