"""Scanner, parser and per-file extraction for PHP text, run inside Arrow workers."""
