"""Sources and object stores."""
