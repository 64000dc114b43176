"""Jobs that keep results current while data arrives."""
