"""DataFrame -> DataFrame operators over the evidence tables."""
