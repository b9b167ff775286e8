"""What is to be done: type hierarchies, event maps and compiled projection plans."""
