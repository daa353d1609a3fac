"""Readers and writers: book files, library documents, manifests."""
