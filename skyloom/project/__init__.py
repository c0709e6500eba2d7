"""Projects: tasks from a setup file, run in order in a directory that can be resumed."""
