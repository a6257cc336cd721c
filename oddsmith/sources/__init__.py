"""Season files in, tables and manifests out."""
