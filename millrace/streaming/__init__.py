"""What grows or runs in the background: builders that rows are appended to, and sketches."""
