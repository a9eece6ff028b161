"""Jobs to run on a schedule: each has a command line, a configuration file and a function that takes a session."""
