"""Session-history analytics and training-corpus operators as Spark DataFrame programs."""
