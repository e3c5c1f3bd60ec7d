"""Sources: text files, positioned raw blocks, PDF (optional) and recorded payloads."""
