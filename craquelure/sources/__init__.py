"""Tables, files and exports."""
