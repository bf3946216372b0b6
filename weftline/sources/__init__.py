"""Where frames come from: files, memory, other libraries, known datasets."""
