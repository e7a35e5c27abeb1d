"""Plans: chunk sizes, fan-in, buffers and shares of memory."""
