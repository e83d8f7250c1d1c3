"""Tables, adapters and writers."""
