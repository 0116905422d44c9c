"""Tables, schemas and foreign keys."""
