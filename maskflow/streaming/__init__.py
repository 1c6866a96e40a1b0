"""The stateless masks on a streaming DataFrame."""
