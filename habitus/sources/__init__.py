"""Reading trees, documents, sidecars and logs; writing artifacts."""
