"""Jobs that run on their own: each has a command line and a configuration file beside it."""
