"""Discovery, allocation, rewriting, verification and reporting."""
