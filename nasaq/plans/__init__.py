"""From options to plans: the command's options, its DataFrame plan, and its output."""
