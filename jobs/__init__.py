"""Jobs to run on a schedule: a command line and a small configuration file each, a function of a session behind it."""
