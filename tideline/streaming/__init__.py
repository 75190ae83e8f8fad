"""Online evaluation: a push engine for one timeline, and Structured Streaming for many."""
