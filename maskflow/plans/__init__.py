"""From a configuration to one DataFrame plan."""
