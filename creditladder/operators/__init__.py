"""DataFrame -> DataFrame steps. Nothing in here runs a job; every step only extends the plan."""
