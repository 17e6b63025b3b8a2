"""Tables, their store, and the registered queries."""
