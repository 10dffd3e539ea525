"""The registered queries, the views they run on, and their independent SQL."""
