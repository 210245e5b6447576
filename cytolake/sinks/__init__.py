"""Writers of genomic text formats."""
