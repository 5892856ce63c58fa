"""The sources are batch tables only; there is nothing to stream."""
