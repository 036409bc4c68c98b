"""Tables, their manifests and the catalog."""
