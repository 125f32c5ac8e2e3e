"""Providers of generated text, scores, labels and embeddings."""
